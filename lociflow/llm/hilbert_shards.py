"""Shards cut from a Hilbert-curve order of documents.

Language, source and size are quantised to BITS bits each: the first two by equal shares of all bytes over their sorted
values, so that codes keep their order, the size by powers of two. Rows are sorted by curve index, then by a hash of
the text and doc_id, and the order is cut into runs of nearly equal bytes. Files of such shards cover small ranges of
each of the three, which lets readers skip by the ranges in their footers. A hot cell is no hot task, as the sort also
runs over hash and doc_id.

Equal texts of one language and source have one cell and one hash: no other text (but for equal hashes) stands between
them, in one shard or in shards that follow each other. Equal texts of other languages or sources stand where those are,
as the order serves skipping; nothing is promised of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import materialise, offsets

BITS, DIMENSIONS = 4, 3


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place on the Hilbert curve of a point whose coordinates have so many bits each.

    From the top bit down, the cell's corner bits are decoded from Gray code after undoing the curve's current entry
    corner and direction, which each step then carries on.
    """
    n, entry, direction, index = len(point), 0, 0, 0
    full = (1 << n) - 1
    turn = lambda v, k: ((v << k % n) | (v >> (n - k % n))) & full
    for b in reversed(range(bits)):
        corner = sum((x >> b & 1) << i for i, x in enumerate(point))
        gray = turn(corner ^ entry, n - (direction + 1) % n)
        rank = gray
        shift = gray >> 1
        while shift:
            rank ^= shift
            shift >>= 1
        index = index << n | rank
        even = 0 if rank == 0 else (rank - 1) & ~1
        entry ^= turn(even ^ even >> 1, direction + 1)
        # bits that change inside this cell's run: trailing ones of the rank, or of the one before it if even
        low = rank - 1 if rank and rank % 2 == 0 else rank
        ones = 0
        while low & 1:
            ones += 1
            low >>= 1
        direction = (direction + (0 if rank == 0 else ones) + 1) % n
    return index


def codes(rows: DataFrame, column: str) -> DataFrame:
    """(column_value, column_code): distinct values by order, as equal shares of size; null is a value, the first one.

    Values are sorted by ranges, and only the ranges' sums run through one task, so they may be many."""
    top = (1 << BITS) - 1
    shares = rows.groupBy(column).agg(F.sum("size").alias("bytes"))
    shares = materialise(shares.repartitionByRange(F.col(column).asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    parts = offsets(shares.groupBy("part").agg(F.sum("bytes").alias("n")), "part", "n").withColumn("total", F.sum("n").over(Window.partitionBy()))
    run = Window.partitionBy("part").orderBy(F.col(column).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("bytes").over(run) + F.col("n_before") - F.col("bytes") / 2
    placed = shares.join(parts.select("part", "n_before", "total"), "part")
    return placed.select(F.col(column).alias(f"{column}_value"), F.least(F.lit(top), F.floor(middle / F.col("total") * (top + 1))).cast("int").alias(f"{column}_code"))


def ordered(docs: DataFrame) -> DataFrame:
    """Rows (rid, doc_id, size, text_crc32, curve, tie, part) in the order's partitions, written. docs may have a rid."""
    spark = docs.sparkSession
    text = F.col("text")
    rid = "rid" if "rid" in docs.columns else F.monotonically_increasing_id().alias("rid")
    rows = materialise(docs.select(rid, "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("tie")))
    top = (1 << BITS) - 1
    keyed = rows
    for c in ("lang", "source"):
        # one row for each value: adaptive execution broadcasts it while it is small and joins it otherwise
        keyed = keyed.join(codes(rows, c), F.col(c).eqNullSafe(F.col(f"{c}_value")), "left")
    keyed = keyed.withColumn("size_code", F.least(F.lit(top), F.floor(F.log2(F.col("size").cast("double")) * F.lit(0.8))).cast("int"))
    axis = range(top + 1)
    curve = spark.createDataFrame([(x, y, z, hilbert_index((x, y, z), BITS)) for x in axis for y in axis for z in axis], "lang_code int, source_code int, size_code int, curve int")
    keyed = keyed.join(F.broadcast(curve), ["lang_code", "source_code", "size_code"])  # 2 ** (BITS * DIMENSIONS) rows
    keyed = materialise(keyed.select("rid", "doc_id", "size", "text_crc32", "curve", "tie"))
    return materialise(keyed.repartitionByRange("curve", "tie", "doc_id").withColumn("part", F.spark_partition_id()))


def placed_rows(docs: DataFrame, shards: int) -> DataFrame:
    """(rid, doc_id, size, text_crc32, shard, slot) of each row of docs (doc_id, text, lang, source, and rid or not)."""
    rows = ordered(docs)
    parts = offsets(rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "part", "bytes", "n")
    parts = parts.withColumn("total", F.sum("bytes").over(Window.partitionBy()))
    w = Window.partitionBy("part").orderBy("curve", "tie", "doc_id", "size", "rid")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(parts.select("part", "bytes_before", "n_before", "total"), "part")
    placed = placed.withColumn("end", F.sum("size").over(run) + F.col("bytes_before")).withColumn("place", F.row_number().over(w) - 1 + F.col("n_before"))
    middle = F.col("end") - F.col("size") / 2
    placed = materialise(placed.select("rid", "doc_id", "size", "text_crc32", "place", F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("total"))).cast("int").alias("shard")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    out = placed.join(F.broadcast(first), "shard")  # a row for each shard
    return out.select("rid", "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of docs (doc_id, text, lang, source).

    size is the UTF-8 bytes of the text plus 1. A null text has size 1 and the checksum of no bytes, 0, as an empty one
    has; null lang or source are a value of their own. Shards take runs of the order of nearly equal bytes (law `bytes`:
    within a document's size); slot counts from 0 in each. Some shards stay empty if single documents exceed a shard's
    share or there are few rows. Repeated rows are rows of their own; other columns aren't read.
    """
    out = placed_rows(docs.select("doc_id", "text", "lang", "source"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, file_rows: int = 100_000) -> DataFrame:
    """Write docs, whole rows, as Parquet folders shard=K under path, sorted by slot in files of file_rows rows; returns
    (doc_id, shard, slot). Rows without doc_id and repeated rows are rows of their own. Where docs has a column `shard`,
    the folders are named shard_=K (with as many more underscores as it takes)."""
    whole = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    where = materialise(placed_rows(whole.select("rid", "row.doc_id", "row.text", "row.lang", "row.source"), shards))
    folder = "shard"
    while folder in {c.lower() for c in docs.columns}:
        folder += "_"
    named = whole.join(where.select("rid", "shard", "slot"), "rid").repartition("shard", F.floor(F.col("slot") / file_rows)).sortWithinPartitions("shard", "slot")
    named.select("row.*", F.col("shard").alias(folder)).write.mode("overwrite").partitionBy(folder).parquet(path)
    return where.select("doc_id", "shard", "slot")
