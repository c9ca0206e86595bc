"""Gap-filled tumbling windows, rolling means and trailing counts, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _spine(found: DataFrame, size: str) -> DataFrame:
    ends = found.agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    return ends.where("lo is not null").select(F.explode(F.expr(f"sequence(lo, hi, interval {size})")).alias("start"))


def window_statistics(df: DataFrame, size: str, ts: str = "ts", value: str = "value", fill: bool = True) -> DataFrame:
    """count, sum, average, std (n-1), min and max of value per tumbling window from the first to the last one.

    An empty window has count and sum 0 and nulls elsewhere. Also fits a
    stream with fill=False, as the spine is unbounded there.
    """
    agg = df.groupBy(F.window(ts, size).alias("w")).agg(
        F.count(value).alias("count"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"),
        F.avg(value).alias("average"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    found = agg.select(F.col("w.start").alias("start"), *(c for c in agg.columns if c != "w"))
    if not fill:
        return found
    return _spine(found, size).join(found, "start", "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("sum", F.coalesce("sum", F.lit(0.0)))


def window_panel(df: DataFrame, size: str, user: str, value: str, flag: str, ts: str = "ts") -> DataFrame:
    """n, mean, flagged count, flagged share (null when empty) and distinct users per gap-filled window."""
    agg = df.groupBy(F.window(ts, size).alias("w")).agg(
        F.count(value).alias("n"), F.avg(value).alias("average"), F.count_if(flag).alias("flagged"), F.avg(F.col(flag).cast("double")).alias("share"), F.countDistinct(user).alias("users")
    )
    found = agg.select(F.col("w.start").alias("start"), *(c for c in agg.columns if c != "w"))
    return _spine(found, size).join(found, "start", "left").na.fill(0, ["n", "flagged", "users"])


def rolling_mean(panel: DataFrame, value: str, rows: int = 30, start: str = "start") -> DataFrame:
    """The mean over this row of a gap-filled panel and the rows - 1 before it; nulls are skipped."""
    frame = Window.orderBy(start).rowsBetween(-(rows - 1), 0)
    return panel.select(start, F.avg(value).over(frame).alias("rolling"))


def trailing_ones(df: DataFrame, bit: str, n: int, order: list[str], group: str) -> DataFrame:
    """The exact number of ones among the last n rows of a group, at each row."""
    frame = Window.partitionBy(group).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("ones", F.sum(F.col(bit).cast("long")).over(frame))


def compare_windows(df: DataFrame, sizes: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Per window size, over windows that hold rows: n, mean, std, min, max and cv% of the window means."""
    parts = [window_statistics(df, s, ts, value, fill=False).select(F.lit(s).alias("size"), "average") for s in sizes]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    out = whole.groupBy("size").agg(F.count("average").alias("n"), F.avg("average").alias("mean"), F.stddev_samp("average").alias("std"), F.min("average").alias("min"), F.max("average").alias("max"))
    return out.withColumn("cv_pct", 100 * F.col("std") / F.col("mean"))


def stream_statistics(stream: DataFrame, size: str, ts: str = "ts", value: str = "value", lateness: str = "1 hour") -> DataFrame:
    """window_statistics of a stream, with a watermark; unfilled, as the spine belongs to reading."""
    return window_statistics(stream.withWatermark(ts, lateness), size, ts, value, fill=False)
