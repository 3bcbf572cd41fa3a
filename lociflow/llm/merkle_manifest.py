"""A Merkle manifest of a dataset, by mountain-range stacks over indexed partitions.

Leaves are ordered by group (source), then doc_id, and cut into partitions by range; counts of partitions give each
leaf its place in its group. A task walks its leaves with a stack that carries like a counter of base FAN: FAN nodes of
a level, aligned to the group's places, become a node of the next. What has no parent when the task ends are its peaks.
Peaks of neighbouring partitions meet in rounds of MERGED partitions at a time, until each group has its root: there
nodes whose children lie in several partitions are made, and the short last runs, which aren't padded. Subroots are
leaves of the top tree, made the same way.

A proof needs the siblings of each node on the way up. A partition makes those inside it again and is sent those that
lie over its edges: a few for each level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import materialise

#: Children of a node, partitions whose peaks a task merges, and leaves of a partition.
FAN, MERGED, LEAVES = 3, 64, 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "part long, key string, level int, at long, digest string, peak boolean"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Hash of the fields one after the other: `-` for null, else the bytes' number, `:` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def width(leaves: int, level: int) -> int:
    """Nodes of a level over so many leaves."""
    return -(-leaves // FAN**level)


def height(leaves: int) -> int:
    """Levels above the leaves."""
    h = 0
    while FAN**h < leaves:
        h += 1
    return h


def climb(nodes: dict[tuple[int, int], str], total: int) -> tuple[dict[tuple[int, int], str], set[tuple[int, int]]]:
    """Add every parent all of whose children are in nodes ((level, place): digest) of a group of so many leaves;
    returns the added ones and the keys of those that have a parent. A level's last run may be short."""
    added: dict[tuple[int, int], str] = {}
    covered: set[tuple[int, int]] = set()
    waiting: dict[int, set[int]] = {}
    for level, at in nodes:
        waiting.setdefault(level, set()).add(at // FAN)
    level, top = min(waiting, default=0), height(total)
    while level < top:
        wide = width(total, level)
        for run in sorted(waiting.get(level, ())):
            children = [(level, at) for at in range(run * FAN, min(run * FAN + FAN, wide))]
            if (level + 1, run) not in nodes and all(c in nodes for c in children):
                nodes[level + 1, run] = added[level + 1, run] = digest("".join(nodes[c] for c in children))
                covered.update(children)
                waiting.setdefault(level + 1, set()).add(run // FAN)
        level += 1
    return added, covered


def mountains(leaves: list[str], start: int, total: int) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(peaks, other nodes) as (level, place, digest) over consecutive leaves from place start of a group of total.

    stack[level] holds the nodes of the current run: a run that is full, or the group's last, carries to the next level.
    Runs that began before `start` can't be full here; their nodes are peaks."""
    stack: list[list[tuple[int, str]]] = [[] for _ in range(height(total) + 1)]
    peaks, made = [], []

    def push(level: int, at: int, value: str) -> None:
        while True:
            run = stack[level]
            if run and run[0][0] // FAN != at // FAN:
                peaks.extend((level, *x) for x in run)
                run.clear()
            run.append((at, value))
            ends = at % FAN == FAN - 1 or at == width(total, level) - 1
            if not ends or run[0][0] % FAN or width(total, level) == 1:
                return
            made.extend((level, *x) for x in run)
            value = digest("".join(x[1] for x in run))
            run.clear()
            level, at = level + 1, at // FAN

    for i, value in enumerate(leaves):
        push(0, start + i, value)
    for level, run in enumerate(stack):
        peaks.extend((level, *x) for x in run)
    return peaks, made


@dataclass(frozen=True)
class Tree:
    """leaves (part, key, place, digest and what came with them), spans (part, key, start, n, total) of each partition
    and group, and nodes (part, key, level, at, digest, peak): all nodes that a round made or left."""

    leaves: DataFrame
    spans: DataFrame
    nodes: DataFrame
    rounds: int

    def edges(self) -> DataFrame:
        """(key, level, at, digest) of the nodes that were some round's peaks, or made of them."""
        return self.nodes.where("peak").select("key", "level", "at", "digest").distinct()

    def roots(self) -> DataFrame:
        """(key, root, total) of each group."""
        sizes = self.spans.groupBy("key").agg(F.max("total").alias("total"))
        # the top level holds one node; FAN ** level < total on all levels under it
        top = self.edges().join(sizes, "key").where((F.col("at") == 0) & (F.pow(F.lit(float(FAN)), "level") >= F.col("total")))
        return top.groupBy("key", "total").agg(F.min_by("digest", "level").alias("root"))


def grow(rows: DataFrame, *order: str) -> Tree:
    """The trees of rows (key, digest and others), one for each key, leaves in the order given.

    rows must be a written table. Rows that are equal in all of key, order and digest stand in any order, which changes no
    hash."""
    spark = rows.sparkSession
    n = rows.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 500), -(-n // LEAVES))
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = materialise(tied.repartitionByRange(parts, "key", *order, "digest", "tie").withColumn("part", F.spark_partition_id().cast("long")))
    counts = ordered.groupBy("key", "part").agg(F.count("*").alias("n"))
    by = Window.partitionBy("key")
    spans = materialise(counts.select("part", "key", "n", F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(by).alias("total")))
    walked = Window.partitionBy("part", "key").orderBy(*order, "digest", "tie")
    placed = ordered.join(spans.select("part", "key", "start", "total"), ["part", "key"])
    leaves = materialise(placed.withColumn("place", F.col("start") + F.row_number().over(walked) - 1).drop("start", "tie"))

    def walk(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        table = table.sort_by([("key", "ascending"), ("place", "ascending")])
        keys, values, places, totals = (table[c].to_pylist() for c in ("key", "digest", "place", "total"))
        out, i = [], 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            peaks, made = mountains(values[i:j], places[i], totals[i])
            out += [(part, keys[i], *x, True) for x in peaks] + [(part, keys[i], *x, False) for x in made if x[0]]
            i = j
        return rowwise(out)

    nodes = materialise(leaves.select("part", "key", "place", "digest", "total").groupBy("part").applyInArrow(walk, NODES))
    totals = spans.groupBy("key").agg(F.max("total").alias("total"))
    rounds, left, found = 0, (spans.agg(F.max("part")).first()[0] or 0) + 1, nodes

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = key[0].as_py(), key[1].as_py()
        held, total = {}, 0
        for batch in batches:
            for level, at, value, total in zip(*(batch.column(c).to_pylist() for c in ("level", "at", "digest", "total"))):
                held[level, at] = value
        before = set(held)
        added, covered = climb(held, total)
        out = [(part, name, *k, v, True) for k, v in added.items()] + [(part, name, *k, held[k], True) for k in before - covered]
        yield from rowwise(out).to_batches()

    while left > 1:
        left, rounds = -(-left // MERGED), rounds + 1
        peaks = found.where("peak").join(totals, "key").where(F.pow(F.lit(float(FAN)), "level") < F.col("total")).withColumn("part", F.floor(F.col("part") / MERGED))
        found = materialise(peaks.groupBy("part", "key").applyInArrow(merge, NODES))
        nodes = nodes.unionByName(found)
    return Tree(leaves, spans, nodes, rounds)


def rowwise(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()))], ["part", "key", "level", "at", "digest", "peak"])


def over_edges(tree: Tree) -> DataFrame:
    """(part, key, level, at, digest): nodes beside the first and the last leaf's ways up in each partition that doesn't
    hold its whole group."""
    split = tree.spans.where("n < total").withColumn("levels", F.sequence(F.lit(0), F.ceil(F.log(F.col("total").cast("double")) / F.log(F.lit(float(FAN)))).cast("int") + 1))
    ways = split.select("part", "key", "start", "n", F.explode("levels").alias("level")).withColumn("size", F.pow(F.lit(FAN), F.col("level") + 1).cast("long"))
    runs = ways.select("part", "key", "level", F.explode(F.array_distinct(F.array(F.expr("start div size"), F.expr("(start + n - 1) div size")))).alias("run"))
    wanted = runs.select("part", "key", "level", F.explode(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda k: F.col("run") * FAN + k)).alias("at"))
    return wanted.join(tree.edges(), ["key", "level", "at"]).select("part", "key", "level", "at", "digest")


def ways_up(nodes: dict[tuple[int, int], str], total: int, place: int) -> list[tuple[str, str]]:
    """For each level the digests before and after the node on the way from a leaf to its root, of its run."""
    out = []
    for level in range(height(total)):
        first, wide = place - place % FAN, width(total, level)
        out.append(("".join(nodes[level, k] for k in range(first, place)), "".join(nodes[level, k] for k in range(place + 1, min(first + FAN, wide)))))
        place //= FAN
    return out


def proved(tree: Tree, kept: str, schema: str, told, above: DataFrame | None = None) -> DataFrame:
    """Rows that told(row, way) gives for each leaf, with schema: row holds digest and the columns of kept (comma
    separated), way the pairs of ways_up to the root of its group and then those of above (key, way), if given."""
    columns = ["part", "key", "place", "digest", "total", *[c for c in kept.split(",") if c]]
    pair = "array<struct<b:string,a:string>>"
    aid = over_edges(tree).withColumn("way", F.lit(None).cast(pair))
    if above is not None:
        whole = tree.spans.select("part", "key").join(above, "key")
        aid = aid.unionByName(whole.select("part", "key", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("digest"), F.col("way").cast(pair).alias("way")))

    def tell(table: pa.Table, aid: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("place", "ascending")])
        beside: dict[str, dict[tuple[int, int], str]] = {}
        upper: dict[str, list[tuple[str, str]]] = {}
        for key, level, at, value, way in zip(*(aid[c].to_pylist() for c in ("key", "level", "at", "digest", "way"))):
            if level < 0:
                upper[key] = [(x["b"], x["a"]) for x in way]
            else:
                beside.setdefault(key, {})[level, at] = value
        rows, out, i = table.to_pylist(), [], 0
        while i < len(rows):
            key, total, j = rows[i]["key"], rows[i]["total"], i
            while j < len(rows) and rows[j]["key"] == key:
                j += 1
            nodes = {(0, r["place"]): r["digest"] for r in rows[i:j]}
            climb(nodes, total)
            nodes |= beside.get(key, {})
            top = upper.get(key, [])
            out += [told(r, ways_up(nodes, total, r["place"]) + top) for r in rows[i:j]]
            i = j
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.table([pa.array(c, kinds[k]) for k, c in enumerate(zip(*out))] if out else [pa.array([], t) for t in kinds], names)

    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}.get(x.split()[1], pa.list_(pa.struct([("b", pa.string()), ("a", pa.string())]))) for x in schema.split(", ")]
    return tree.leaves.select(*columns).groupBy("part").cogroup(aid.groupBy("part")).applyInArrow(tell, schema)


def folded(value: str, way: list[tuple[str, str]]) -> str:
    for before, after in way:
        value = digest(before + value + after)
    return value


def manifest(docs: DataFrame) -> tuple[Tree, Tree]:
    """The trees of the sources and the one over their roots. docs: doc_id, source, lang, n_chars, text."""
    columns = [F.col(c) for c in FIELDS]
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    tampered = F.when(touched, leaf([*columns[:-1], F.replace("text", F.lit("\n"), F.lit(""))]))
    # nulls first, and no text sorts between them and the empty one
    key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    rows = materialise(docs.select(*FIELDS).select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf(columns).alias("digest"), tampered.alias("tampered")))
    tree = grow(rows, "doc_id")
    tops = materialise(tree.roots().select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("root").alias("digest")))
    return tree, grow(tops, "name")


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs (doc_id, source, lang,
    n_chars, text).

    Each row is a leaf; a null in any column is a value of its own. Leaves ascend by doc_id in their source, null ids
    first, and rows of one doc_id by their hash; equal rows have equal hashes and proofs of their own. The tampered leaf is
    without the text's line feeds, for even checksums of doc_id; rows without doc_id aren't tampered with. A proof without
    siblings (one row in all) is the hash of no text. An empty table gives no rows; other columns aren't read.
    """
    tree, top = manifest(docs)
    pair = "array<struct<b:string,a:string>>"
    above = materialise(proved(top, "name", f"key string, subroot string, way {pair}", lambda r, way: (r["name"], r["digest"], [{"b": b, "a": a} for b, a in way])))
    found = top.roots().first()
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    root = found.root

    def told(r: dict, way: list[tuple[str, str]]) -> tuple:
        back = folded(r["tampered"] or r["digest"], way)
        return r["key"], r["doc_id"], r["digest"], digest("".join(b + a for b, a in way)), back, back == root

    rows = proved(tree, "doc_id,tampered", "key string, doc_id long, leaf string, proof_sha256 string, folded_root string, verified boolean", told, above.select("key", "way"))
    return rows.join(above.select("key", "subroot"), "key").select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", "verified")
