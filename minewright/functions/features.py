"""Feature vectors of items, and their alignment by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minewright.operators.eda import split_categories


def feature_matrix(items: DataFrame, reviews: DataFrame, most: int = 1500, categories: int = 20) -> DataFrame:
    """(id, v, label) of the `most` items (item_id, categories) with most reviews (item_id, stars).

    v is the mean of stars, ln(1 + reviews), and a flag for each of the most
    frequent categories among these items; label is the whole part of the mean
    less 1. Ties go to the smaller id or name. The names are at most `categories`.
    """
    rated = reviews.groupBy("item_id").agg(F.avg("stars").alias("stars"), F.count(F.lit(1)).alias("n"))
    top = items.join(rated, "item_id").orderBy(F.desc("n"), "item_id").limit(most).withColumn("own", F.array_distinct(split_categories("categories")))
    counted = top.select(F.explode("own").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    names = [r["name"] for r in counted.orderBy(F.desc("n"), "name").limit(categories).collect()]
    flags = [F.array_contains("own", name).cast("double") for name in names]
    return top.select(F.col("item_id").alias("id"), F.array(F.col("stars"), F.log1p("n"), *flags).alias("v"), (F.floor("stars") - 1).cast("int").alias("label"))


def align(order: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(id, v) of every id of order, with zeros where vectors (id, v) has none."""
    return order.select("id").join(vectors, "id", "left").select("id", F.coalesce("v", F.array_repeat(F.lit(0.0), width)).alias("v"))


def concatenate(one: DataFrame, two: DataFrame, width: int) -> DataFrame:
    """(id, v) of one, each vector followed by that of two (id, v) for the same id, or by zeros."""
    return one.select("id", F.col("v").alias("u")).join(align(one, two, width), "id").select("id", F.concat("u", "v").alias("v"))


def attribute_tokens(attributes: Column) -> Column:
    """Tokens of a map of attributes: the key where the value is "True", key_value for other texts but "False"."""
    kept = F.filter(F.map_entries(attributes), lambda e: e["value"].isNotNull() & (e["value"] != "False"))
    return F.transform(kept, lambda e: F.when(e["value"] == "True", e["key"]).otherwise(F.concat_ws("_", e["key"], e["value"])))


def cluster_means(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, i, mean): the mean of each dimension of points (id, v) over the members of each cluster (id, label)."""
    long = points.select("id", "v").join(labels.select("id", "label"), "id").select("label", F.posexplode("v").alias("i", "x"))
    return long.groupBy("label", "i").agg(F.avg("x").alias("mean"))


def cluster_profile(items: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """(label, size, stars, reviews, rank, category, n, share) of each cluster, noise (-1) included.

    items has (id, stars, reviews, categories), labels (id, label). stars and
    reviews are means; a row for each of the k most frequent categories, ties
    by name, with its count over the size; one row without a category where a
    cluster has none.
    """
    members = items.join(labels.select("id", "label"), "id")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.avg("stars").alias("stars"), F.avg("reviews").alias("reviews"))
    named = members.select("label", F.explode(split_categories("categories")).alias("category")).groupBy("label", "category").agg(F.count(F.lit(1)).alias("n"))
    top = named.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "category"))).where(F.col("rank") <= k)
    return sizes.join(top, "label", "left").select("label", "size", "stars", "reviews", "rank", "category", "n", (F.col("n") / F.col("size")).alias("share"))
