"""Statistics over marker batches that arrive as a stream, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_frequencies(g: DataFrame) -> DataFrame:
    """sid, n and af over all batches so far of a stream g(iid, sid, gt); write it in `complete` or `update` mode."""
    return g.groupBy("sid").agg(F.count("gt").alias("n"), (F.avg("gt") / 2).alias("af"))


def running_products(pairs: DataFrame) -> DataFrame:
    """(i, j, n, value) over all batches so far of a stream of tile products (i, j, n, s), as pair_products makes them of
    each batch of markers: both sums add up over markers."""
    return pairs.groupBy("i", "j").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("value"))


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of a stream events(ts, event_type, value) by tumbling or sliding windows, behind a watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    s = events.withWatermark("ts", late) if events.isStreaming else events
    return s.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """User sessions that a gap ends."""
    s = events.withWatermark("ts", late) if events.isStreaming else events
    return s.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
