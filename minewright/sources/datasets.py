"""The domain views (reviews, ratings, items, edges) over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minewright.operators.cleaning import keep_last
from minewright.runtime import table


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reviews: (user_id, item_id, stars 1..5, ts, useful, order_key, line)."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("stars"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_returnflag") == "R").alias("useful"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating per (user_id, item_id): the latest."""
    read = reviews(spark, sf_dir).select("user_id", "item_id", "ts", "order_key", "line", "stars")
    return keep_last(read, ["user_id", "item_id"], ["ts", "order_key", "line"]).select("user_id", "item_id", "stars")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as businesses: (item_id, name, price, size, categories)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("size"),
        F.concat_ws(", ", "p_type", "p_brand", F.regexp_replace("p_name", " +", ", ")).alias("categories"),
    )


def edges(spark: SparkSession, sf_dir: str, stars: int | None = None, useful_only: bool = False) -> DataFrame:
    """The bipartite graph (src user, dst item) of all reviews, or of those with so many stars and useful ones alone."""
    picked = reviews(spark, sf_dir)
    if stars is not None:
        picked = picked.where(F.col("stars") == stars)
    if useful_only:
        picked = picked.where("useful")
    return picked.select(
        F.concat(F.lit("U_"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("P_"), F.col("item_id").cast("string")).alias("dst")
    ).distinct()


#: The same views in SQL, to be put after WITH.
REVIEWS_SQL = """reviews AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS stars,
         l_shipdate AS ts, l_returnflag = 'R' AS useful, l_orderkey AS order_key, l_linenumber AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RATINGS_SQL = REVIEWS_SQL + """, ratings AS (
  SELECT user_id, item_id, stars FROM reviews
  QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, order_key DESC, line DESC) = 1)"""
ITEMS_SQL = """items AS (
  SELECT p_partkey AS item_id, p_name AS name, p_retailprice AS price, p_size AS size,
         concat_ws(', ', p_type, p_brand, regexp_replace(p_name, ' +', ', ', 'g')) AS categories
  FROM part)"""
EDGES_SQL = REVIEWS_SQL + """, edges AS (
  SELECT DISTINCT 'U_' || user_id AS src, 'P_' || item_id AS dst FROM reviews WHERE stars = 5)"""
ALL_EDGES_SQL = EDGES_SQL.replace(" WHERE stars = 5", "")
USEFUL_EDGES_SQL = EDGES_SQL.replace("stars = 5", "stars = 5 AND useful")
