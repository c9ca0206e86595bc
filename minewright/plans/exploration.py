"""Cleaning, sampling and exploratory queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minewright.operators import cleaning, eda, sampling
from minewright.plans.registry import query
from minewright.runtime import table
from minewright.sources.datasets import ITEMS_SQL, RATINGS_SQL, REVIEWS_SQL, items, ratings, reviews

REVIEW_ORDER = ["ts", "order_key", "line"]


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("cln1_null_profile", f"""WITH {REVIEWS_SQL}
SELECT 'user_id' AS "column", count(*) FILTER (user_id IS NULL) AS nulls FROM reviews UNION ALL
SELECT 'item_id', count(*) FILTER (item_id IS NULL) FROM reviews UNION ALL
SELECT 'stars', count(*) FILTER (stars IS NULL) FROM reviews""")
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.null_profile(reviews(spark, sf), ["user_id", "item_id", "stars"])


@query("cln4_dedupe_latest", f"WITH {RATINGS_SQL} SELECT user_id, item_id, stars FROM ratings")
def dedupe_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ratings(spark, sf)


@query("cln5_range", "SELECT p_partkey AS item_id, p_retailprice AS price FROM part WHERE p_retailprice BETWEEN 950 AND 1200")
def price_range(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.in_range(items(spark, sf), "price", 950, 1200).select("item_id", "price")


@query("cln6_orphans_semi", f"WITH {REVIEWS_SQL} SELECT stars, count(*) AS n FROM reviews WHERE item_id IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY stars")
def kept_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return eda.value_histogram(cleaning.with_parent(reviews(spark, sf), items(spark, sf).where("size <= 45"), "item_id"), "stars").withColumnRenamed("value", "stars")


@query("cln6_orphans_anti", f"WITH {REVIEWS_SQL} SELECT stars, count(*) AS n FROM reviews WHERE item_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY stars")
def orphan_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return eda.value_histogram(cleaning.orphans(reviews(spark, sf), items(spark, sf).where("size <= 45"), "item_id"), "stars").withColumnRenamed("value", "stars")


@query("cln_full_report", f"""WITH {REVIEWS_SQL}, shop AS (SELECT p_partkey AS item_id FROM part WHERE p_size <= 45),
single AS (SELECT DISTINCT user_id, item_id FROM reviews)
SELECT 'reviews_read' AS step, count(*) AS rows FROM reviews UNION ALL
SELECT 'reviews_whole', count(*) FROM reviews UNION ALL
SELECT 'reviews_single', count(*) FROM single UNION ALL
SELECT 'reviews_in_range', count(*) FROM single UNION ALL
SELECT 'reviews_kept', count(*) FROM single SEMI JOIN shop USING (item_id) UNION ALL
SELECT 'items_kept', count(*) FROM shop UNION ALL
SELECT 'categories_imputed', 0""")
def full_report(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_reviews(reviews(spark, sf), items(spark, sf).where("size <= 45"), REVIEW_ORDER)[2]


@query("cln7_describe_price", """SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, round(quantile_cont(x, .25), 6) AS q1,
round(quantile_cont(x, .5), 6) AS median, round(quantile_cont(x, .75), 6) AS q3, max(x) AS max FROM (SELECT p_retailprice AS x FROM part)""")
def describe_price(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cleaning.describe(items(spark, sf), "price"), "mean", "std", "q1", "median", "q3")


@query("cln8_iqr_outliers", """WITH b AS (SELECT quantile_cont(o_totalprice, .75) + 0.25 * (quantile_cont(o_totalprice, .75) - quantile_cont(o_totalprice, .25)) AS u FROM orders)
SELECT o_orderkey, o_totalprice, round(u, 6) AS upper_bound FROM orders, b WHERE o_totalprice > u""")
def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    found = cleaning.iqr_outliers(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.25)
    return rounded(found, "upper_bound")


@query("cln9_encode_ids", f"WITH {REVIEWS_SQL} SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_index FROM (SELECT DISTINCT item_id FROM reviews)")
def encode_ids(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.encode_ids(reviews(spark, sf), "item_id", "item_index")


@query("smp1_hash_sample", "SELECT event_id, user_id, value FROM events ORDER BY md5('42_' || event_id), event_id LIMIT 500")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf, "events").select("event_id", "user_id", "value"), "event_id", 500)


@query("smp2_head", "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 100")
def head(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.head(table(spark, sf, "events").select("event_id", "user_id", "ts"), 100, ["ts", "event_id"]).drop("ts")


@query("smp4_user_centric", f"""WITH {REVIEWS_SQL}, sizes AS (SELECT user_id, count(*) AS n, md5('42_' || user_id) AS lot FROM reviews GROUP BY user_id),
run AS (SELECT user_id, sum(n) OVER (ORDER BY lot, user_id) - n AS before FROM sizes)
SELECT user_id, count(*) AS n FROM reviews WHERE user_id IN (SELECT user_id FROM run WHERE before < 3000) GROUP BY user_id""")
def user_centric(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.user_centric_sample(reviews(spark, sf), "user_id", 3000).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("smp5_stratified", """SELECT event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42_' || event_id), event_id) <= 50""")
def stratified(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 50)


@query("eda1_star_hist", f"WITH {REVIEWS_SQL} SELECT stars AS value, count(*) AS n FROM reviews GROUP BY stars")
def star_hist(spark: SparkSession, sf: str) -> DataFrame:
    return eda.value_histogram(reviews(spark, sf), "stars")


@query("eda2_log_hist", """WITH v AS (SELECT log10(o_totalprice) AS x FROM orders), b AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
c AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 50) + 1, 50) AS BIGINT) AS bin, count(*) AS n FROM v, b GROUP BY 1)
SELECT s.bin, round(pow(10, lo + (s.bin - 0.5) * (hi - lo) / 50), 4) AS centre, coalesce(n, 0) AS n
FROM (SELECT unnest(range(1, 51)) AS bin) s CROSS JOIN b LEFT JOIN c USING (bin)""")
def log_hist(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.log_histogram(table(spark, sf, "orders"), "o_totalprice"), "centre", digits=4)


@query("eda3_top_categories", f"""WITH {ITEMS_SQL}, c AS (SELECT trim(unnest(string_split(categories, ','))) AS category FROM items)
SELECT category, count(*) AS n FROM c WHERE category <> '' GROUP BY category ORDER BY n DESC, category LIMIT 15""")
def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    return eda.top_categories(items(spark, sf), "categories")


@query("eda6_segment_stats", """WITH s AS (SELECT n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT n_name FROM s GROUP BY n_name ORDER BY count(*) DESC, n_name LIMIT 5)
SELECT n_name, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median FROM s SEMI JOIN t USING (n_name) GROUP BY n_name""")
def segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    return rounded(eda.segment_statistics(table(spark, sf, "customer").join(nation, "c_nationkey"), "n_name", "c_acctbal"), "mean", "median")


RETENTION_SQL = f"""WITH {REVIEWS_SQL}, d AS (SELECT item_id, count(*) AS d FROM reviews GROUP BY item_id),
curve AS (SELECT k, 100.0 * count(*) FILTER (d >= k) / count(*) AS users_pct, 100.0 * coalesce(sum(d) FILTER (d >= k), 0) / sum(d) AS rows_pct
  FROM d, (SELECT unnest(range(1, 41)) AS k) GROUP BY k)"""


@query("eda7_retention_curve", RETENTION_SQL + " SELECT k, round(users_pct, 6) AS users_pct, round(rows_pct, 6) AS rows_pct FROM curve")
def retention_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.retention_curve(reviews(spark, sf), "item_id", 40), "users_pct", "rows_pct")


@query("eda8_elbow", RETENTION_SQL + """, e AS (SELECT min(k) AS x0, max(k) AS x1, arg_min(users_pct, k) AS y0, arg_max(users_pct, k) AS y1 FROM curve)
SELECT CAST(k AS DOUBLE) AS x, round(users_pct, 6) AS y,
round(abs((x1 - x0) * (y0 - users_pct) - (x0 - k) * (y1 - y0)) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6) AS distance
FROM curve, e ORDER BY distance DESC, x LIMIT 1""")
def elbow(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.elbow(eda.retention_curve(reviews(spark, sf), "item_id", 40), "k", "users_pct"), "y", "distance")


@query("eda9_hour_profile", "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(value) AS n, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def hour_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(eda.time_profile(table(spark, sf, "events"), "ts", "value", "hour"), "sum", digits=4), "mean")


@query("eda10_dow_hour_pivot", "SELECT CAST(isodow(ts) - 1 AS INTEGER) AS dow, " + ", ".join(f"count(*) FILTER (hour(ts) = {h}) AS h{h}" for h in range(24)) + " FROM events GROUP BY 1")
def dow_hour_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return eda.dow_hour_pivot(table(spark, sf, "events"), "ts")


@query("eda11_year_month_pivot", "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, " + ", ".join(f"count(*) FILTER (month(l_shipdate) = {m}) AS m{m}" for m in range(1, 13)) + " FROM lineitem GROUP BY 1")
def year_month_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return eda.year_month_pivot(table(spark, sf, "lineitem"), "l_shipdate")


@query("eda12_user_item_means", f"WITH {REVIEWS_SQL} SELECT user_id, item_id, round(avg(stars), 6) AS mean FROM reviews GROUP BY ALL")
def user_item_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.user_item_means(reviews(spark, sf), "user_id", "item_id", "stars"), "mean")
