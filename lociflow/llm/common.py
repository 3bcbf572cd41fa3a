"""What the operators of this subpackage share: tables written between steps, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as every operator here counts them: runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; on a cluster its absence is an error, as
    no machine-local folder would do.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lociflow-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back with its own schema."""
    path = f"{shared_folder(df.sparkSession)}/lociflow/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from materialise() that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tree_sum(parts: DataFrame, tasks: int, fan_in: int = 32) -> np.ndarray | None:
    """Sum of equally long arrays: rows (slot long, v binary: doubles), a slot for each of `tasks` tasks at most.

    Arrays are added in groups of fan_in until so many are left, which alone reach the driver; within a group by slot,
    so that the same parts give the same last digits. None if there is no row."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            held |= {slot: np.frombuffer(v) for slot, v in zip(batch.column("slot").to_pylist(), batch.column("v").to_pylist())}
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([sum(held[k] for k in sorted(held)).tobytes()], pa.binary())], ["slot", "v"])

    while tasks > fan_in:
        parts = parts.groupBy(F.floor(F.col("slot") / fan_in).alias("slot_")).applyInArrow(add, "slot long, v binary")
        tasks = -(-tasks // fan_in)
    rows = sorted(parts.collect(), key=lambda r: r.slot)
    return sum(np.frombuffer(r.v) for r in rows) if rows else None


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b: long), root being the smallest node of its component.

    Alternating large-star and small-star rounds: each replaces a node's edges by edges to its smallest neighbour, so
    the number of edges never grows and long chains shrink by halves. Every round is a min-aggregate (combined before
    the shuffle) and a join that adaptive execution may split when one node holds many edges; it is written to the
    shared folder, so the plan stays short and a lost executor costs one round at most.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            near = near.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        # large: larger neighbours of u go to m. small: a holds the larger end, so all neighbours and u itself do.
        joined = near.join(least, "u")
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    e = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct()
    e, seen = materialise(e), None
    for _ in range(most_rounds):
        mark = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, old = mark, e
        e = materialise(star(star(e, True), False))
        discard(old)
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def offsets(parts: DataFrame, order: str, *amounts: str, by: str | None = None) -> DataFrame:
    """Exclusive running sums of amounts over rows that stand for partitions, in the order given (within by).

    parts has one row for each partition (and value of by), not one for each row of data.
    """
    from pyspark.sql import Window

    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({f"{a}_before": F.coalesce(F.sum(a).over(w), F.lit(0)) for a in amounts})
