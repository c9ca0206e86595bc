"""Exploratory statistics as tidy frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def log_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin 1..bins, centre, n) over equal steps of log10 between least and greatest; the last bin is closed, empty bins are rows."""
    spark = df.sparkSession
    logs = df.select(F.log10(F.col(column).cast("double")).alias("x")).where("x is not null")
    bounds = logs.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    placed = logs.join(F.broadcast(bounds)).select(
        F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))).otherwise(1).cast("long").alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spine = spark.range(1, bins + 1).select(F.col("id").alias("bin")).join(F.broadcast(bounds))
    centre = F.pow(F.lit(10.0), F.col("lo") + (F.col("bin") - 0.5) * (F.col("hi") - F.col("lo")) / bins)
    return spine.join(counts, "bin", "left").select("bin", centre.alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


def split_categories(column: str) -> Column:
    return F.filter(F.transform(F.split(F.col(column), ","), lambda x: F.trim(x)), lambda x: x != "")


def top_categories(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """(category, n) of the k most frequent; ties by name."""
    return df.select(F.explode(split_categories(column)).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(k)


def top_groups(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(k)


def segment_statistics(df: DataFrame, group: str, value: str, k: int = 5) -> DataFrame:
    """n, mean and median of value for each of the k greatest groups."""
    top = top_groups(df, group, k).select(group)
    x = F.col(value).cast("double")
    return df.join(F.broadcast(top), group).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"))


def retention_curve(df: DataFrame, user: str, most: int = 10) -> DataFrame:
    """For k = 1..most the share of users with k rows or more, and of the rows that they hold."""
    degrees = df.groupBy(user).agg(F.count(F.lit(1)).alias("d"))
    # Degrees above the last k are alike, so at most `most` rows are left.
    held = degrees.groupBy(F.least("d", F.lit(most)).alias("k")).agg(F.count(F.lit(1)).alias("users"), F.sum("d").alias("rows"))
    spine = df.sparkSession.range(1, most + 1).select(F.col("id").alias("k")).join(held, "k", "left").na.fill(0)
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return spine.select(
        "k",
        (100.0 * F.sum("users").over(up) / F.sum("users").over(whole)).alias("users_pct"),
        (100.0 * F.sum("rows").over(up) / F.sum("rows").over(whole)).alias("rows_pct"),
    )


def elbow(curve: DataFrame, x: str, y: str) -> DataFrame:
    """The point (x, y, distance) of a small curve that is furthest from the line through its ends; the first of equals."""
    ends = curve.agg(F.min_by(y, x).alias("y0"), F.min(x).alias("x0"), F.max_by(y, x).alias("y1"), F.max(x).alias("x1"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    gap = F.abs(dx * (F.col("y0") - F.col(y)) - (F.col("x0") - F.col(x)) * dy) / F.sqrt(dx * dx + dy * dy)
    far = curve.join(F.broadcast(ends)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), gap.alias("distance"))
    return far.orderBy(F.desc("distance"), "x").limit(1)


def time_profile(df: DataFrame, ts: str, value: str, unit: str) -> DataFrame:
    """count, sum and mean of value by hour or month."""
    part = {"hour": F.hour, "month": F.month}[unit](F.col(ts))
    return df.groupBy(part.alias(unit)).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"))


def dow_hour_pivot(df: DataFrame, ts: str, value: str | None = None) -> DataFrame:
    """One row per weekday (Monday 0), a column h0..h23: counts (missing 0), or means of value (missing null)."""
    cell = F.count(F.lit(1)) if value is None else F.avg(value)
    placed = df.withColumn("_hour", F.hour(ts))
    wide = placed.groupBy(F.weekday(ts).alias("dow")).pivot("_hour", list(range(24))).agg(cell)
    wide = wide.select("dow", *(F.col(str(h)).alias(f"h{h}") for h in range(24)))
    return wide.na.fill(0) if value is None else wide


def year_month_pivot(df: DataFrame, ts: str) -> DataFrame:
    """One row per year, a column m1..m12 of counts."""
    dated = df.select(F.year(ts).alias("year"), F.month(ts).alias("month"))
    wide = dated.groupBy("year").pivot("month", list(range(1, 13))).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select("year", *(F.col(str(m)).alias(f"m{m}") for m in range(1, 13)))


def user_item_means(df: DataFrame, user: str, item: str, value: str) -> DataFrame:
    """The user by item matrix of mean values, in long form."""
    return df.groupBy(user, item).agg(F.avg(value).alias("mean"))
