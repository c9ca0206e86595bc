"""Cleaning: null profiles, imputation, de-duplication, range and orphan filters, summaries, dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minewright.runtime import materialize


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls) of each listed column, in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns))
    return counts.select(F.inline(pairs))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in `order`.

    An aggregate rather than a window: rows of a hot key are combined before
    the shuffle instead of being sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys + order]
    row = F.struct(*order, *rest)
    best = df.groupBy(*keys).agg(F.max(row).alias("row"))
    return best.select(*keys, *(F.col("row").getField(c).alias(c) for c in order + rest)).select(df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is least in `order`."""
    rest = [c for c in df.columns if c not in keys + order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("row"))
    return best.select(*keys, *(F.col("row").getField(c).alias(c) for c in order + rest)).select(df.columns)


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows with low <= column <= high; nulls go."""
    return df.where(F.col(column).between(low, high))


def with_parent(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the parents (left semi)."""
    return df.join(parents.select(key), key, "left_semi")


def orphans(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the parents (left anti)."""
    return df.join(parents.select(key), key, "left_anti")


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std (n-1), min, exact quartiles and max of a column."""
    x = F.col(column).cast("double")
    quarter = lambda p: F.percentile(x, F.lit(p))
    return df.agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        quarter(0.25).alias("q1"),
        quarter(0.5).alias("median"),
        quarter(0.75).alias("q3"),
        F.max(x).alias("max"),
    )


def iqr_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows above Q3 + factor * (Q3 - Q1); the bound is one broadcast row."""
    x = F.col(column).cast("double")
    bound = df.agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    bound = bound.select((F.col("q")[1] + factor * (F.col("q")[1] - F.col("q")[0])).alias("upper_bound"))
    return df.join(F.broadcast(bound), x > F.col("upper_bound"))


def encode_ids(df: DataFrame, column: str, index: str = "index") -> DataFrame:
    """(column, index): dense 0-based numbers of the distinct non-null values in ascending order.

    Values are range-partitioned and sorted, and each partition starts where
    the counts of those before it end, so nothing is numbered in one task. The
    broadcast side has one row per partition.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    spread = values.repartitionByRange(column).sortWithinPartitions(column).select(column, F.spark_partition_id().alias("part"))
    placed = materialize(spread, "ids")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return placed.join(F.broadcast(starts), "part").select(column, (F.col("start") + rank - 1).alias(index))


def clean_reviews(reviews: DataFrame, items: DataFrame, order: list[str], critical: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews, items, report) after all cleaning steps, in the order null, category, duplicate, range, orphan.

    report has a row (step, rows) per count; it is one lazy union.
    """
    critical = critical or ["user_id", "item_id", "stars"]
    whole = reviews.na.drop(subset=critical)
    named = items.na.drop(subset=["item_id", "name"])
    filled = named.na.fill("Uncategorized", ["categories"])
    single = keep_first(whole, ["user_id", "item_id"], order)
    ranged = in_range(single, "stars", 1, 5)
    catalogue = filled.groupBy("item_id").agg(F.min(F.struct(*[c for c in filled.columns if c != "item_id"])).alias("row")).select("item_id", "row.*")
    final = with_parent(ranged, catalogue, "item_id")

    def count(step: str, df: DataFrame, keep: Column | None = None) -> DataFrame:
        return df.agg(F.lit(step).alias("step"), (F.count(F.lit(1)) if keep is None else F.count_if(keep)).alias("rows"))

    report = count("reviews_read", reviews)
    for step, df in (("reviews_whole", whole), ("reviews_single", single), ("reviews_in_range", ranged), ("reviews_kept", final), ("items_kept", catalogue)):
        report = report.union(count(step, df))
    return final, catalogue, report.union(count("categories_imputed", named, F.col("categories").isNull()))
