"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.operators.skew import join_counted
from minewright.runtime import discard, materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"),
    ).first()
    return int(row["n"]), int(row["h"] or 0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    Returns (node, component). Self-loops give their node a row; null ends are
    dropped; an empty edge table gives an empty result. Each round is a
    large-star and a small-star step: the edge count never grows, and a hub is
    met only in a min() aggregate with map-side combine and in a join whose
    other side has one row per node, which for hubs is broadcast. The number of
    rounds is logarithmic in the size of the graph. State is kept as written
    tables, so losing an executor costs no recomputation of earlier rounds.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    now = materialize(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "stars",
    )
    seen = _state(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = materialize(least.select("u", F.least("u", "m").alias("m"), "n"), "stars-least")
        large = join_counted(both.where("v > u"), least, ["u"], 2 * seen[0]).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.where("hi <> lo").distinct(), "stars-large")
        # A node has no more rows here than it had neighbours, all of them smaller.
        root = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            join_counted(large, root, ["hi"], seen[0])
            .select(F.col("lo").alias("x"), F.col("m"))
            .union(root.select(F.col("hi").alias("x"), "m"))
            .where("x <> m")
            .select(F.col("x").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        then = materialize(small, "stars")
        after = _state(then)
        discard(now, least, large)
        now = then
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError("connected_components did not settle")
    label = now.groupBy("hi").agg(F.min("lo").alias("component"))
    return loops.join(label.withColumnRenamed("hi", "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
