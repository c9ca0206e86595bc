"""Seeded samples that depend on keys, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lot(key: Column, seed: int) -> Column:
    """The pseudo-random position of a key: 32 hex digits."""
    return F.md5(F.concat_ws("_", F.lit(str(seed)), key.cast("string")))


def hash_sample(df: DataFrame, key: str | Column, k: int, seed: int = 42) -> DataFrame:
    """k rows, uniform over keys: the least lots. Planned as a bounded heap per partition."""
    key = F.col(key) if isinstance(key, str) else key
    return df.withColumn("_lot", lot(key, seed)).orderBy("_lot", key).limit(k).drop("_lot")


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def stratified_sample(df: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """At most k rows of each group; Spark cuts each partition's groups to k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(lot(F.col(key), seed), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def user_centric_sample(df: DataFrame, user: str, target: int, seed: int = 42) -> DataFrame:
    """All rows of as many users, in the order of their lots, as are needed to reach target rows.

    The user that crosses the target is included. The running sum is taken
    over 4096 slices of the lots and then within each slice, so that no task
    sees all users.
    """
    sizes = df.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).withColumn("_lot", lot(F.col(user), seed))
    sizes = sizes.withColumn("_slice", F.substring("_lot", 1, 3))
    slices = sizes.groupBy("_slice").agg(F.sum("_n").alias("_sum"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_slice").orderBy("_lot", user).rowsBetween(Window.unboundedPreceding, 0)
    running = sizes.join(F.broadcast(slices), "_slice").withColumn("_before", F.col("_base") + F.sum("_n").over(within) - F.col("_n"))
    return df.join(running.where(F.col("_before") < target).select(user), user, "left_semi")
