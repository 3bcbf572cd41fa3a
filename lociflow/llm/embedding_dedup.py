"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its DEPTH nearest reference points (pivots), nearest first: its permutation. Inverted lists
hold, for each label and pivot, the vectors that have it among their POSTED nearest. Two vectors of a list are
candidates if their permutations share at least SHARED pivots; the list of the smallest pivot that both are posted under
owns the pair. Lists hold numbers and permutations alone. Vectors then travel only to lists where they have a candidate,
and matrix products verify candidates by cosine. Lists over LIST_ROWS are cut into parts, and each pair of parts is a
task of its own. Pairs are never rows: a task returns, for each vector, how many it links with, and edges that span the
components it found. Equal vectors of one label are one entry, which counts for all its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import connected_components, materialise
from lociflow.llm.simhash_dedup import by_key, union

DEPTH, POSTED, SHARED = 8, 3, 4
LIST_ROWS = 2048
#: Pivots grow with the square root of the vectors, between these bounds, and take at most PIVOT_BYTES for each length.
LEAST_PIVOTS, MOST_PIVOTS, PIVOT_BYTES = 64, 16_384, 16 << 20
#: Rows of a tile that are compared with all others at once.
BLOCK = 256


def usable(vector: str) -> F.Column:
    """Neither null nor with null, infinite or NaN components."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that squares neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def describe(rows: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    near = rows @ pivots.T
    depth = min(depth, len(pivots))
    top = np.argpartition(-near, depth - 1, axis=1)[:, :depth]
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int32)


def candidates(a: np.ndarray, b: np.ndarray, pivot: int, posted: int, shared: int) -> np.ndarray:
    """Of permutations a and b (rows) in the list of a pivot: which pairs share enough pivots and belong to this list."""
    count = np.zeros((len(a), len(b)), np.int8)
    owned = np.ones((len(a), len(b)), bool)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            same = a[:, i, None] == b[None, :, j]
            count += same
            if i < posted and j < posted:
                owned &= ~(same & (a[:, i, None] < pivot))
    return owned & (count >= min(shared, a.shape[1]))


def tile_pairs(t: pd.DataFrame, posted: int, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, other rows, which are candidates) of one tile by blocks: columns eid, pivots, part, x, y, p."""
    first, second, pivot = int(t["x"].iat[0]), int(t["y"].iat[0]), int(t["p"].iat[0])
    part, shape = t["part"].to_numpy(), np.stack(list(t["pivots"]))
    mine, others = np.flatnonzero(part == first), np.flatnonzero(part == second)
    for i in range(0, len(mine), BLOCK):
        a = mine[i : i + BLOCK]
        hit = candidates(shape[a], shape[others], pivot, posted, shared)
        if first == second:
            hit &= a[:, None] < others[None, :]
        yield a, others, hit


def tile_links(t: pd.DataFrame, least: float, posted: int, shared: int) -> Iterator[pd.DataFrame]:
    """Link counts and spanning edges of one tile: columns as in tile_pairs(), copies and vector."""
    t = t.sort_values("eid", kind="stable")
    eid, copies = t["eid"].to_numpy(), t["copies"].to_numpy()
    rows = unit(np.stack(list(t["vector"])))
    links, root = np.zeros(len(t), np.int64), np.arange(len(t))
    for a, others, hit in tile_pairs(t, posted, shared):
        x, y = np.nonzero(hit & (rows[a] @ rows[others].T >= least))
        np.add.at(links, a[x], copies[others[y]])
        np.add.at(links, others[y], copies[a[x]])
        union(root, a[x], others[y])
    while (root[root] != root).any():
        root = root[root]
    some = np.flatnonzero((links > 0) | (root != np.arange(len(t))))
    if len(some):
        yield pd.DataFrame({"eid": eid[some], "links": links[some], "other": eid[root[some]]})


def pick_pivots(entries: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each length of vectors its pivots, unit vectors: those with the least hashes, a bounded sample.

    Lengths are as many as models that made the vectors; each is read apart."""
    picked = {}
    wanted = min(max(64 * -(-int((n / 2) ** 0.5) // 64), LEAST_PIVOTS), MOST_PIVOTS)
    for d in sorted(r.d for r in entries.select(F.size("vector").alias("d")).distinct().collect()):
        few = min(wanted, max(1, PIVOT_BYTES // (8 * d)))
        own = entries.where(F.size("vector") == d).orderBy(F.xxhash64("code", "label"), "eid").select("vector").limit(few)
        picked[d] = unit(np.array([r.vector for r in own.collect()]))
    return picked


def near_duplicates(vectors: DataFrame, least: float = 0.98, depth: int = DEPTH, posted: int = POSTED, shared: int = SHARED, list_rows: int = LIST_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id and kept of each row: links are pairs of one label (and length) with cosine >= least.

    Rows without label or id, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing: n_links 0, the row's own id as component. Copies (repeated rows included; by 128 bits of hashes) link with
    each other. Other columns aren't read.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.col(label_col).alias("label"))
    ok = usable("vector") & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # -0.0 and 0.0 are equal to a cosine, so their hashes must be.
    plus = F.transform("vector", lambda x: (x + F.lit(0.0)).cast(kind[6:-1]))
    rows = rows.withColumn("vector", F.when(ok, plus))
    rows = materialise(rows.withColumns({"code": F.when(ok, F.xxhash64("vector")), "code2": F.when(ok, F.xxhash64(F.lit(1), "vector"))}))
    entries = rows.where("code is not null").groupBy("label", "code", "code2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    entries = materialise(entries.withColumn("eid", F.monotonically_increasing_id()))
    out = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id").isNotNull()).alias("kept"))
    n = entries.count()
    if n == 0:
        return out
    known = vectors.sparkSession.sparkContext.broadcast(pick_pivots(entries, n))

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The permutation of each vector."""
        for batch in batches:
            column = batch.column(2)
            values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy()))))
            width = np.diff(offsets)
            for d in np.unique(width):
                at = np.flatnonzero(width == d)
                top = describe(unit(values[offsets[at][:, None] + np.arange(d)]), known.value[int(d)], depth)
                own = batch.take(pa.array(at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * top.shape[1], pa.int32()), pa.array(top.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(at), d, np.int32)), lists], ["eid", "label", "d", "pivots"])

    of_label = dict(entries.dtypes)["label"]
    shaped = materialise(entries.select("eid", "label", "vector").mapInArrow(shape, f"eid long, label {of_label}, d int, pivots array<int>"))
    key = ["label", "d", "p"]
    lists = shaped.select("eid", "label", "d", F.explode(F.slice("pivots", 1, posted)).alias("p"), "pivots")
    sizes = lists.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / list_rows).cast("int").alias("parts"))
    tiles = lists.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("eid"), F.col("parts")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other"))
    tiles = tiles.select("eid", *key, "part", "x", "y", "pivots")

    def retrieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of a tile that have a candidate in it."""
        for _, t in by_key(batches, [*key, "x", "y"]):
            some = np.zeros(len(t), bool)
            for a, others, hit in tile_pairs(t, posted, shared) if len(t) > 1 else ():
                some[a[hit.any(axis=1)]] = True
                some[others[hit.any(axis=0)]] = True
            if some.any():
                yield t[some]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, t in by_key(batches, [*key, "x", "y"]):
            yield from tile_links(t, least, posted, shared)

    dealt = lambda t: t.repartition(*key, "x", "y").sortWithinPartitions(*key, "x", "y")
    near = materialise(dealt(tiles).mapInPandas(retrieve, f"eid long, label {of_label}, d int, p int, part int, x int, y int, pivots array<int>"))
    full = near.join(entries.select("eid", "copies", "vector"), "eid")
    found = materialise(dealt(full).mapInPandas(verify, "eid long, links long, other long"))
    links = found.groupBy("eid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("eid <> other").select(F.col("eid").alias("a"), F.col("other").alias("b")))
    named = entries.select("label", "code", "code2", "eid", "rep", "copies").join(links, "eid", "left").join(roots.withColumnRenamed("node", "eid"), "eid", "left")
    named = materialise(named.select("label", "code", "code2", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("found_links"), F.coalesce("root", "eid").alias("root")))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component")), "root").drop("root", "rep")
    out = rows.select("vec_id", "label", "code", "code2").join(named, ["label", "code", "code2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("found_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
