"""Approximate counts of ones in a sliding window, from the places of the ones.

The exponential histogram of Datar, Gionis, Indyk and Motwani keeps one or two
buckets of each size 1, 2, 4, ..., the newest of size 1. One or two of each is
the notation of the number of ones in base two with digits 1 and 2, which every
number has once. So the buckets follow from that number alone: with m ones,
(m + 1) // 2**j - 1 of them are left in units of 2**j for size 2**j and up, and
that is odd where there is one bucket of the size. A bucket's time is the place
of its newest one, and buckets that ended n or more places ago don't count.

No state is carried from row to row. Rows are numbered by range, so a group of
any size is spread over tasks, and each group joins O(log m) bucket heads.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minewright.runtime import materialize


def numbered(df: DataFrame, order: list[str], bit: str, group: str | None = None) -> DataFrame:
    """(grp, place, bit, ones): each row's place in its group from 1, and the ones up to it.

    Null bits are zeros. Rows are sorted by range; only the counts of each
    range and group meet in one place.
    """
    name = F.col(group).cast("string") if group else F.lit("all")
    rows = df.select(name.alias("grp"), F.coalesce(F.col(bit).cast("int"), F.lit(0)).alias("bit"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    keys = ["grp", *(f"o{i}" for i in range(len(order)))]
    rows = materialize(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "dgim-rows")
    size = rows.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("k"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select("grp", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "k")))
    own = Window.partitionBy("grp", "part").orderBy(*keys[1:])
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("at", F.row_number().over(own)).withColumn("sum", F.sum("bit").over(upto)).join(size, ["grp", "part"]).select(
        "grp", (F.col("at") + F.col("n0")).alias("place"), "bit", (F.col("sum") + F.col("k0")).alias("ones")
    )


def heads(ends: DataFrame) -> DataFrame:
    """(grp, now, size, one) for ends (grp, now, m): each bucket, and which of the group's m ones is its newest."""
    levels = ends.withColumn("j", F.explode(F.expr("sequence(0, greatest(0, int(log2(m + 1))))")))
    levels = levels.withColumn("size", F.expr("shiftleft(1L, j)")).withColumn("left", F.expr("(m + 1) div size - 1")).where("left > 0")
    each = levels.withColumn("i", F.explode(F.expr("sequence(0, int(1 - left % 2))")))
    return each.select("grp", "now", "size", F.expr("left * size - i * size").alias("one"))


def estimates(rows: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """(grp, now, estimate, buckets, bits) at the places `now` of ends (grp, now, m): all live buckets less half the oldest."""
    ones = rows.where("bit = 1").select("grp", F.col("ones").alias("one"), "place")
    live = heads(ends).join(ones, ["grp", "one"]).where(F.col("place") > F.col("now") - n)
    summed = live.groupBy("grp", "now").agg((F.sum("size") - F.max("size") / 2).alias("estimate"), F.count(F.lit(1)).alias("buckets"))
    out = ends.select("grp", "now").join(summed, ["grp", "now"], "left")
    return out.select("grp", "now", F.coalesce("estimate", F.lit(0.0)).alias("estimate"), F.coalesce("buckets", F.lit(0)).cast("long").alias("buckets")).withColumn(
        "bits", F.col("buckets") * memory_bits(n)
    )


def memory_bits(n: int) -> float:
    """Bits of one bucket: an end among n places, and an exponent, twice over."""
    return 2 * math.log2(math.log2(n) + 1) + math.log2(n) if n > 1 else 0.0


def dgim_by_group(df: DataFrame, group: str, order: list[str], bit: str, n: int) -> DataFrame:
    """(grp, estimate, buckets, bits) of the ones among the last n rows of each group."""
    rows = materialize(numbered(df, order, bit, group), "dgim-places")
    ends = rows.groupBy("grp").agg(F.max("place").alias("now"), F.max("ones").alias("m"))
    return estimates(rows, ends, n).drop("now")


def dgim_evaluate(df: DataFrame, order: list[str], bit: str, ns: list[int], checkpoints: int = 80) -> DataFrame:
    """(n, now, estimate, exact) at evenly spaced places of the whole stream, for each n not above its length."""
    rows = materialize(numbered(df, order, bit), "dgim-places")
    total = rows.count()
    step = max(1, total // checkpoints)
    ends = rows.where(F.col("place") % step == 0).select("grp", F.col("place").alias("now"), F.col("ones").alias("m"))
    out = None
    for n in (n for n in ns if n <= total):
        was = rows.select("grp", (F.col("place") + n).alias("now"), F.col("ones").alias("gone"))
        exact = ends.join(was, ["grp", "now"], "left").select("grp", "now", (F.col("m") - F.coalesce("gone", F.lit(0))).alias("exact"))
        one = estimates(rows, ends, n).join(exact, ["grp", "now"]).select(F.lit(n).alias("n"), "now", "estimate", "exact")
        out = one if out is None else out.union(one)
    return rows.sparkSession.createDataFrame([], "n int, now long, estimate double, exact long") if out is None else out


def dgim_errors(evaluated: DataFrame) -> DataFrame:
    """(n, mean_error, max_error): relative errors over the checkpoints with any one in the window."""
    error = F.abs(F.col("estimate") - F.col("exact")) / F.col("exact")
    return evaluated.where("exact > 0").groupBy("n").agg(F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))
