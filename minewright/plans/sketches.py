"""Window and sketch queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minewright.plans.exploration import rounded
from minewright.plans.registry import query
from minewright.runtime import table
from minewright.streaming import dgim, sketches, windows

STATS = ("sum", "average", "std")


def stats_sql(size: str) -> str:
    return f"""WITH w AS (SELECT time_bucket(INTERVAL '{size}', ts) AS start, value FROM events),
s AS (SELECT unnest(generate_series((SELECT min(start) FROM w), (SELECT max(start) FROM w), INTERVAL '{size}')) AS start)
SELECT s.start, count(value) AS count, round(coalesce(sum(value), 0), 6) AS sum, round(avg(value), 6) AS average, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max
FROM s LEFT JOIN w ON s.start = w.start GROUP BY s.start"""


for _size, _name in (("1 hour", "1h"), ("4 hours", "4h"), ("1 day", "1d")):
    query(f"str1_window_stats_{_name}", stats_sql(_size))(lambda spark, sf, size=_size: rounded(windows.window_statistics(table(spark, sf, "events"), size), *STATS))

PANEL_SQL = """WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, value, user_id, event_type = 'purchase' AS flag FROM events),
s AS (SELECT unnest(generate_series((SELECT min(start) FROM w), (SELECT max(start) FROM w), INTERVAL '1 day')) AS start),
panel AS (SELECT s.start, count(value) AS n, avg(value) AS average, count(*) FILTER (flag) AS flagged, avg(CAST(flag AS INTEGER)) AS share, count(DISTINCT user_id) AS users
FROM s LEFT JOIN w ON s.start = w.start GROUP BY s.start)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    flagged = table(spark, sf, "events").withColumn("flag", F.col("event_type") == "purchase")
    return windows.window_panel(flagged, "1 day", "user_id", "value", "flag")


@query("str2_window_panel", PANEL_SQL + " SELECT start, n, round(average, 6) AS average, flagged, round(share, 6) AS share, users FROM panel")
def window_panel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel(spark, sf), "average", "share")


@query("win1_rolling_mean", PANEL_SQL + " SELECT start, round(avg(n) OVER (ORDER BY start ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS rolling FROM panel")
def rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windows.rolling_mean(panel(spark, sf), "n"), "rolling")


@query("win4_trailing_ones", """SELECT event_id, CAST(sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS ones FROM events""")
def trailing_ones(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("bit"))
    return windows.trailing_ones(rows, "bit", 20, ["ts", "event_id"], "user_id").select("event_id", "ones")


@query("eda13_compare_windows", "WITH a AS (" + " UNION ALL ".join(f"SELECT '{s}' AS size, avg(value) AS m FROM events GROUP BY time_bucket(INTERVAL '{s}', ts)" for s in ("1 hour", "4 hours", "1 day"))
       + ") SELECT size, count(m) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, round(min(m), 6) AS min, round(max(m), 6) AS max, round(100 * stddev_samp(m) / avg(m), 6) AS cv_pct FROM a GROUP BY size")
def compare_windows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windows.compare_windows(table(spark, sf, "events"), ["1 hour", "4 hours", "1 day"]), "mean", "std", "min", "max", "cv_pct")


def cell_sql(salt: str, key: str, width: int) -> str:
    rest = "0::BIGINT"
    for i in range(4):
        rest = f"(({rest} * 4294967296 + ('0x' || substr(md5({salt} || '_' || {key}), {8 * i + 1}, 8))::BIGINT) % {width})"
    return rest


def salts_sql(depth: int) -> str:
    return "(VALUES " + ", ".join(f"({i}, {s}::BIGINT)" for i, s in enumerate(sketches.salts(depth))) + ") AS t(row, salt)"


def cells_sql(depth: int, width: int) -> str:
    return f"SELECT row, {cell_sql('salt', 'l_partkey', width)} AS cell, CAST(count(*) AS BIGINT) AS n FROM lineitem, {salts_sql(depth)} GROUP BY 1, 2"


@query("str3_cms_cells", cells_sql(4, 2000))
def cms_cells(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.cms_cells(table(spark, sf, "lineitem"), "l_partkey")


def estimates_sql(depth: int, width: int) -> str:
    return f"""SELECT key, min(n) AS estimate FROM (SELECT l_partkey AS key, row, {cell_sql("salt", "l_partkey", width)} AS cell FROM (SELECT DISTINCT l_partkey FROM lineitem), {salts_sql(depth)})
JOIN ({cells_sql(depth, width)}) USING (row, cell) GROUP BY key"""


@query("str4_cms_estimates", estimates_sql(4, 500))
def cms_estimates(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return sketches.cms_estimate(sketches.cms_cells(lines, "l_partkey", 4, 500), lines, "l_partkey", 4, 500)


SWEEP = [(4, 100), (4, 500), (4, 2000), (1, 500), (2, 500)]


@query("str6_cms_sweep", " UNION ALL ".join(f"SELECT {d} AS depth, {w} AS width, round(avg(estimate - t), 6) AS mean_error, max(estimate - t) AS max_error FROM ({estimates_sql(d, w)}) JOIN (SELECT l_partkey AS key, count(*) AS t FROM lineitem GROUP BY 1) USING (key)" for d, w in SWEEP))
def cms_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sketches.cms_evaluate(table(spark, sf, "lineitem"), "l_partkey", SWEEP), "mean_error")


def registers_sql(p: int) -> str:
    return f"""SELECT h >> {32 - p} AS register, CAST(max(CASE WHEN h % {2 ** (32 - p)} = 0 THEN {33 - p} ELSE {32 - p} - length(ltrim(bin(h % {2 ** (32 - p)}), '0')) + 1 END) AS INTEGER) AS rank
FROM (SELECT ('0x' || substr(md5('42_' || l_partkey), 1, 8))::BIGINT AS h FROM lineitem) GROUP BY 1"""


def hll_sql(p: int) -> str:
    m, a = 2**p, sketches.hll_alpha(p)
    return f"""SELECT CASE WHEN raw <= {2.5 * m} AND e > 0 THEN {m}.0 * ln({m}.0 / e) ELSE raw END AS estimate
FROM (SELECT {m} - count(*) AS e, {a * m * m} / (sum(pow(2.0, -rank)) + {m} - count(*)) AS raw FROM ({registers_sql(p)}))"""


@query("str11_hll_registers", registers_sql(11))
def hll_registers(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.hll_registers(table(spark, sf, "lineitem"), "l_partkey")


@query("str12_hll_estimate", f"SELECT round(estimate, 6) AS estimate FROM ({hll_sql(11)})")
def hll_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sketches.hll_estimate(sketches.hll_registers(table(spark, sf, "lineitem"), "l_partkey")), "estimate")


@query("str14_hll_sweep", " UNION ALL ".join(f"SELECT {p} AS p, round(estimate, 6) AS estimate, round({1.04 / 2 ** (p / 2)}, 6) AS bound, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS \"true\" FROM ({hll_sql(p)})" for p in (4, 8, 11)))
def hll_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sketches.hll_sweep(table(spark, sf, "lineitem"), "l_partkey", [4, 8, 11]), "estimate", "bound")


#: Buckets of the ones in base two with digits 1 and 2, from a table t (grp, place, bit, ones) and e (grp, now, m).
BUCKETS_SQL = """h AS (SELECT grp, now, size, lft * size - i * size AS one FROM (SELECT grp, now, size, (m + 1) // size - 1 AS lft FROM e, (SELECT CAST(pow(2, j) AS BIGINT) AS size FROM range(0, 40) r(j))),
  (SELECT unnest([0, 1]) AS i) WHERE lft > 0 AND i <= 1 - lft % 2),
b AS (SELECT h.grp, now, size, place FROM h JOIN t ON t.grp = h.grp AND t.ones = h.one AND t.bit = 1)"""


@query("str7_dgim", f"""WITH t AS (SELECT event_type AS grp, CAST(coalesce(value > 50, false) AS INTEGER) AS bit, row_number() OVER w AS place, sum(CAST(coalesce(value > 50, false) AS INTEGER)) OVER w AS ones
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), e AS (SELECT grp, max(place) AS now, max(ones) AS m FROM t GROUP BY 1), {BUCKETS_SQL},
s AS (SELECT grp, sum(size) - max(size) / 2 AS estimate, count(*) AS buckets FROM b WHERE place > now - 1000 GROUP BY 1)
SELECT grp, coalesce(estimate, 0.0) AS estimate, coalesce(buckets, 0) AS buckets, round(coalesce(buckets, 0) * {dgim.memory_bits(1000)!r}, 6) AS bits FROM e LEFT JOIN s USING (grp)""")
def dgim_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", "ts", "event_id", (F.col("value") > 50).alias("bit"))
    return rounded(dgim.dgim_by_group(rows, "event_type", ["ts", "event_id"], "bit", 1000), "bits")


@query("str10_dgim_evaluation", "WITH t AS (SELECT 'all' AS grp, CAST(coalesce(value > 50, false) AS INTEGER) AS bit, row_number() OVER w AS place, sum(CAST(coalesce(value > 50, false) AS INTEGER)) OVER w AS ones "
       "FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), e AS (SELECT grp, place AS now, ones AS m FROM t WHERE place % greatest(1, (SELECT count(*) FROM t) // 80) = 0), "
       f"{BUCKETS_SQL}, k AS (SELECT unnest([100, 1000, 5000, 100000]) AS n), "
       "s AS (SELECT n, now, sum(size) - max(size) / 2 AS estimate FROM b, k WHERE place > now - n GROUP BY ALL), "
       "x AS (SELECT n, e.now, m - coalesce(t.ones, 0) AS exact FROM e CROSS JOIN k LEFT JOIN t ON t.place = e.now - n WHERE n <= (SELECT count(*) FROM t)) "
       "SELECT n, round(avg(abs(coalesce(estimate, 0) - exact) / exact), 8) AS mean_error, round(max(abs(coalesce(estimate, 0) - exact) / exact), 8) AS max_error FROM x LEFT JOIN s USING (n, now) WHERE exact > 0 GROUP BY n")
def dgim_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("ts", "event_id", (F.col("value") > 50).alias("bit"))
    return rounded(dgim.dgim_errors(dgim.dgim_evaluate(rows, ["ts", "event_id"], "bit", [100, 1000, 5000, 100000])), "mean_error", "max_error", digits=8)
