"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees of routed shards.

Fingerprints within radius r of each other agree on at least BANDS - r of BANDS bit bands. Every distinct fingerprint
goes to one shard for each choice of BANDS - r bands and their values, so each pair within the radius meets in a shard.
A shard holds a BK-tree (children keyed by their distance to the parent) and searches it for all of its fingerprints
at once, following only edges within the radius. Shards over SHARD_ROWS are cut into parts, and each pair of parts is
a task of its own. Exact copies share a fingerprint and are one entry. Trees aren't broadcast whole: all fingerprints
would have to pass the driver, whose memory no bound would cover; they are built where their shard's probes arrive.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import connected_components, materialise

SEED = 42
RADIUS = 4
BANDS = 6
SHARD_ROWS = 4096

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, words: int = 4) -> int:
    """Bit b is set if it is set in over half of the XXH64 hashes of the text's shingles, repeats counted.

    A text with fewer words is one shingle; one without words, empty or null, gives zero.
    """
    tokens = _words(text.translate(_lower)) if text else []
    if not tokens:
        return 0
    joined = [t.encode() for t in tokens]
    line = b" ".join(joined)
    n = len(joined)
    if n <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    starts = list(itertools.accumulate([len(t) + 1 for t in joined], initial=0))
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n - words + 1, 65536):  # very long texts by pieces
        last = min(at + 65536, n - words + 1)
        hashes = b"".join([digest(line[a : b - 1], SEED) for a, b in zip(starts[at:last], starts[at + words : last + words])])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n - words + 1).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row of docs (doc_id, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit values, laid out level by level in arrays.

    Of the values that reach a node at one distance, the first becomes its child at that distance, and the others go
    on from there; so the tree is the one that insertion in order gives.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rest = np.arange(1, n)
        at = np.zeros(len(rest), np.int64)
        while len(rest):
            d = np.bitwise_count(values[rest] ^ values[at]).astype(np.int64)
            key = at * 65 + d
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            child = rest[first]
            parent[child], edge[child] = at[first], d[first]
            stays = np.ones(len(rest), bool)
            stays[first] = False
            at, rest = child[group][stays], rest[stays]
        key = parent * 65 + edge
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def within(self, probes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe number, node number) of all pairs within the radius, by steps of the search."""
        stack = [(np.arange(i, min(i + 2048, len(probes))), np.zeros(min(2048, len(probes) - i), np.int64)) for i in range(0, len(probes), 2048)] if len(self.values) else []
        while stack:
            probe, node = stack.pop()
            d = np.bitwise_count(probes[probe] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield probe[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 1), "left")
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            count = high - low
            total = int(count.sum())
            if total:
                which = np.repeat(np.arange(len(probe)), count)
                child = self.order[np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)]
                for i in range(0, total, 1 << 20):
                    stack.append((probe[which[i : i + (1 << 20)]], child[i : i + (1 << 20)]))


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join sets of a forest in place, for arrays of pairs: roots take the smaller root until none differ."""
    while len(a):
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def shard_links(values: np.ndarray, part: np.ndarray, first: int, second: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the tree of the first part's values finds for the second part's (or for its own)."""
    values, keep = np.unique(values, return_index=True)
    part = part[keep]
    root = np.arange(len(values))
    mine, others = np.flatnonzero(part == first), np.flatnonzero(part == second)
    bits = values.view(np.uint64)
    tree = BKTree(bits[mine])
    for probe, node in tree.within(bits[others], radius):
        union(root, others[probe], mine[node])
    while (root[root] != root).any():
        root = root[root]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return values[moved], values[root[moved]]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, bands: int = BANDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp) with the components of all pairs within the radius."""
    if not 0 <= radius < bands:
        raise ValueError("bands must be more than the radius")
    cuts = [64 * i // bands for i in range(bands + 1)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(bands), bands - radius)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(number).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")))
    routed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.choice", "k.value")
    sizes = routed.groupBy("choice", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int"))
    # A part meets every part of its shard, itself included, in a tile of its own.
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = routed.join(sizes.select("choice", "value", "parts"), ["choice", "value"]).withColumn("part", own)
    tiles = tiles.select("fp", "choice", "value", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("fp", "choice", "value", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by tile; a tile is held at once, which is 2 * shard_rows or so rows at most."""
        for _, t in by_key(batches, ["choice", "value", "x", "y"]):
            if len(t) > 1:
                a, b = shard_links(t["fp"].to_numpy(), t["part"].to_numpy(), int(t["x"].iat[0]), int(t["y"].iat[0]), radius)
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b})

    dealt = tiles.repartition("choice", "value", "x", "y").sortWithinPartitions("choice", "value", "x", "y")
    return dealt.mapInPandas(link, "a long, b long")


def by_key(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of rows with equal keys from batches that are sorted by key; a group may run over several batches."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        k = batch[key].to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(batch)]))
        for s, e in zip(starts[:-1], starts[1:]):
            now = tuple(k[s])
            if now != last and held:
                yield last, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            last = now
            held.append(batch.iloc[s:e])
    if held:
        yield last, pd.concat(held) if len(held) > 1 else held[0]


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of each row of docs.

    Documents without words, null or empty, have fingerprint zero and link like any other. Repeated rows give repeated
    rows. A row without doc_id has a fingerprint, takes no part in links and has no component. Columns of docs beside
    doc_id and text aren't read.
    """
    prints = materialise(fingerprints(docs, words))
    nodes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = materialise(nodes)
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius)).withColumnsRenamed({"node": "fp", "root": "root"})
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    out = prints.join(named, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = 4) -> DataFrame:
    """docs with the row of the smallest doc_id of each component alone, columns as they were.

    Of rows that repeat a doc_id one stays; rows without doc_id, which take no part, all stay.
    """
    from pyspark.sql import Window

    kept = near_duplicates(docs, radius, words).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    named = whole.where("id is not null").join(kept, F.col("id") == F.col("__kept"), "left_semi")
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("row")))).where("n = 1")
    return named.select("row").unionByName(whole.where("id is null").select("row")).select("row.*")
