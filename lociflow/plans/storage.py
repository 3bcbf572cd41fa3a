"""Tables written between steps, in the folder that the session's spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, kind: str = "files") -> str:
    """A new path in the shared folder. A local session without the setting gets a folder of its own; a cluster must
    have it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lociflow-"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


#: Rows of a page of the tables kept. Pages are compressed one by one, and Parquet's own limit of 20,000 rows ends them
#: before a marker's list of individuals comes again.
PAGE_ROWS = 1 << 20


def keep(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    path = place(df.sparkSession, "tables")
    df.write.option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
