"""Numbers and running values of rows in an order over all of them, without a window over all rows.

Rows are sorted by ranges; a row for each partition carries what stands before it (or after it) to the partition's own
window. Only those rows, as many as there are partitions, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.plans.storage import keep

#: Bits of an id of monotonically_increasing_id() that number the rows of a partition.
LOW = 33


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """df sorted by ranges of the order and written, with part_, the number of a row's range."""
    return keep(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))


def carried(parts: DataFrame, value: str, forward: bool = True) -> DataFrame:
    """(part_, before_) over rows (part_, value), one a partition: forward the sum of the values of the parts before, else
    the least value of the parts after."""
    if forward:
        w = Window.partitionBy().orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
        return parts.select("part_", F.coalesce(F.sum(value).over(w), F.lit(0)).alias("before_"))
    w = Window.partitionBy().orderBy(F.desc("part_")).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part_", F.min(value).over(w).alias("before_"))


def running_sum(df: DataFrame, value: str, *order: str | Column, name: str = "size") -> DataFrame:
    """df with the sum of the row's value and those of all rows before it in the order."""
    rows = ranged(df, *order)
    before = carried(rows.groupBy("part_").agg(F.sum(value).alias("v")), "v")
    own = F.sum(value).over(Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(F.broadcast(before), "part_").withColumn(name, own + F.col("before_")).drop("part_", "before_")  # a row a partition


def greatest_before(df: DataFrame, value: str, *order: str | Column, name: str = "greatest") -> DataFrame:
    """df with the greatest value of all rows before it in the order; null where none has one."""
    rows = ranged(df, *order)
    before = Window.unboundedPreceding
    parts = rows.groupBy("part_").agg(F.max(value).alias("v"))
    parts = parts.select("part_", F.max("v").over(Window.partitionBy().orderBy("part_").rowsBetween(before, -1)).alias("before_"))
    own = F.max(value).over(Window.partitionBy("part_").orderBy(*order).rowsBetween(before, -1))
    return rows.join(F.broadcast(parts), "part_").withColumn(name, F.greatest(own, "before_")).drop("part_", "before_")  # a row a partition


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """df with the row's number in the order, from 0. Rows equal in all of the order stand in any order."""
    rows = ranged(df, *order)
    before = carried(rows.groupBy("part_").agg(F.count("*").alias("n")), "n")
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return rows.join(F.broadcast(before), "part_").withColumn(name, (own + F.col("before_")).cast("long")).drop("part_", "before_")  # a row a partition


def numbered_lines(df: DataFrame, name: str) -> DataFrame:
    """df with the row's number from 0 as its partitions follow each other: of lines, as the file has them. Nothing is
    sorted or shuffled; a first pass counts each partition's rows."""
    rows = df.withColumn("o_", F.monotonically_increasing_id())
    part, own = F.shiftright("o_", LOW).cast("int"), F.col("o_").bitwiseAND(F.lit((1 << LOW) - 1))
    before = carried(rows.groupBy(part.alias("part_")).agg(F.count("*").alias("n")), "n")
    return rows.withColumn("part_", part).withColumn("own_", own).join(F.broadcast(before), "part_").withColumn(name, F.col("own_") + F.col("before_")).drop("o_", "own_", "part_", "before_")


def first_ranks(df: DataFrame, x: str, name: str = "rank") -> DataFrame:
    """df with the number of rows whose x is less, plus one; null where x is null. Ranks are of distinct values, so that
    many equal ones are one row until the join."""
    values = ranged(df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("n_")), x)
    before = carried(values.groupBy("part_").agg(F.sum("n_").alias("n")), "n")
    less = F.coalesce(F.sum("n_").over(Window.partitionBy("part_").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = values.join(F.broadcast(before), "part_").select(F.col(x).alias("x_"), (less + F.col("before_") + 1).cast("long").alias(name))
    return df.join(placed, F.col(x) == F.col("x_"), "left").drop("x_")


def least_from_here(df: DataFrame, value: str, *order: str, name: str = "least") -> DataFrame:
    """df with the least value of the row and all rows after it in the order."""
    rows = ranged(df, *order)
    after = carried(rows.groupBy("part_").agg(F.min(value).alias("v")), "v", forward=False)
    own = F.min(value).over(Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return rows.join(F.broadcast(after), "part_").withColumn(name, F.least(own, "before_")).drop("part_", "before_")
