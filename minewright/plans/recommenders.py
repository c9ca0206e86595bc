"""Recommender queries with their oracles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minewright.operators import recommend as rec
from minewright.plans.exploration import rounded
from minewright.plans.registry import ORACLE_SQL, query
from minewright.runtime import materialize
from minewright.sources.datasets import ITEMS_SQL, RATINGS_SQL, items, ratings


def held(spark: SparkSession, sf: str) -> DataFrame:
    """The ratings, written, for what reads them more than once."""
    return materialize(ratings(spark, sf), "ratings")


def near_sql(by: str, across: str, metric: str = "cosine", k: int | None = 10) -> str:
    """CTEs vec, norm and near (a, b, sim)."""
    value = "stars - avg(stars) OVER (PARTITION BY e)" if metric == "pearson" else "stars"
    top = "" if k is None else f" QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= {k}"
    return f"""vec AS MATERIALIZED (SELECT e, x, {value} AS r FROM (SELECT {by} AS e, {across} AS x, stars FROM ratings)),
norm AS MATERIALIZED (SELECT e, CASE WHEN sum(r * r) = 0 THEN 1e-9 ELSE sqrt(sum(r * r)) END AS n FROM vec GROUP BY e),
near AS MATERIALIZED (SELECT a, b, sim FROM (SELECT a, b, round(dot / (p.n * q.n), 8) AS sim FROM (SELECT s.e AS a, t.e AS b, sum(s.r * t.r) AS dot FROM vec s JOIN vec t ON s.x = t.x AND s.e <> t.e GROUP BY 1, 2)
  JOIN norm p ON p.e = a JOIN norm q ON q.e = b) WHERE sim > 0{top})"""


@query("rec2_popularity_topk", f"""WITH {RATINGS_SQL}, c AS (SELECT item_id, count(*) AS n FROM ratings GROUP BY 1), m AS (SELECT 5 + max(k) AS m FROM (SELECT count(*) AS k FROM ratings GROUP BY user_id)),
best AS (SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id) AS p FROM c QUALIFY p <= (SELECT m FROM m))
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY p) AS INTEGER) AS rank, item_id FROM (SELECT DISTINCT user_id FROM ratings) CROSS JOIN best
ANTI JOIN ratings USING (user_id, item_id) QUALIFY rank <= 5""")
def popularity(spark: SparkSession, sf: str) -> DataFrame:
    return rec.popularity_topk(ratings(spark, sf), 5)


@query("rec4_user_cosine", f"WITH {RATINGS_SQL}, {near_sql('user_id', 'item_id')} SELECT a, b, sim FROM near")
def user_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rec.neighbours(held(spark, sf))


@query("rec4_user_pearson", f"WITH {RATINGS_SQL}, {near_sql('user_id', 'item_id', 'pearson')} SELECT a, b, sim FROM near")
def user_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return rec.neighbours(held(spark, sf), metric="pearson")


@query("rec5_item_cosine", f"WITH {RATINGS_SQL}, {near_sql('item_id', 'user_id')} SELECT a, b, sim FROM near")
def item_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rec.neighbours(held(spark, sf), "item_id", "user_id")


USER_SCORES = f"{near_sql('user_id', 'item_id')}, scores AS MATERIALIZED (SELECT a AS user_id, item_id, sum(sim * stars) / sum(sim) AS score FROM near JOIN ratings r ON r.user_id = b GROUP BY ALL)"


@query("rec6_cf_user_topk", f"""WITH {RATINGS_SQL}, {USER_SCORES} SELECT user_id, item_id, round(score, 8) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 8) DESC, item_id) AS INTEGER) AS rank
FROM scores ANTI JOIN ratings USING (user_id, item_id) QUALIFY rank <= 5""")
def cf_user(spark: SparkSession, sf: str) -> DataFrame:
    return rec.user_topk(held(spark, sf))


@query("rec7_cf_item_topk", f"""WITH {RATINGS_SQL}, {near_sql('item_id', 'user_id', k=None)}, c AS (SELECT user_id, b AS item_id, a, sim, stars FROM ratings r JOIN near ON r.item_id = a),
n AS (SELECT * FROM c ANTI JOIN ratings USING (user_id, item_id) QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, a) <= 10),
s AS (SELECT user_id, item_id, round(sum(sim * stars) / sum(sim), 8) AS score FROM n GROUP BY ALL)
SELECT user_id, item_id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def cf_item(spark: SparkSession, sf: str) -> DataFrame:
    return rec.item_topk(held(spark, sf))


HOLDOUT = """active AS (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 4 ORDER BY user_id LIMIT 100),
good AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS size, row_number() OVER (PARTITION BY user_id ORDER BY md5('42_' || user_id || '_' || item_id), item_id) AS place
  FROM ratings SEMI JOIN active USING (user_id) SEMI JOIN (SELECT item_id FROM ratings GROUP BY 1 HAVING count(*) >= 5) USING (item_id) WHERE stars >= 3.5),
hidden AS MATERIALIZED (SELECT user_id, item_id, stars FROM good WHERE size >= 2 AND place <= greatest(1, floor(size * 0.3)))"""


@query("rec18_holdout", f"WITH {RATINGS_SQL}, {HOLDOUT} SELECT user_id, item_id, stars FROM hidden")
def holdout(spark: SparkSession, sf: str) -> DataFrame:
    return rec.holdout(ratings(spark, sf))


@query("rec9_cf_rating", f"""WITH {RATINGS_SQL}, {HOLDOUT}, {USER_SCORES} SELECT h.user_id, h.item_id, round(coalesce(CASE WHEN score > 0 THEN score END,
(SELECT avg(stars) FROM ratings r WHERE r.user_id = h.user_id), 3.0), 8) AS prediction FROM hidden h LEFT JOIN scores s ON s.user_id = h.user_id AND s.item_id = h.item_id""")
def cf_rating(spark: SparkSession, sf: str) -> DataFrame:
    rows = held(spark, sf)
    pairs = materialize(rec.holdout(rows).select("user_id", "item_id"), "pairs")
    return rounded(rec.rating_with_fallback(pairs, rec.user_scores(rows, only=pairs), rows), "prediction", digits=8)


TFIDF = f"""{ITEMS_SQL}, tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, trim(unnest(string_split(categories, ','))) AS term FROM items) WHERE term <> '' GROUP BY ALL),
raw AS (SELECT item_id, term, tf * (ln((1.0 + (SELECT count(*) FROM items)) / (1 + count(*) OVER (PARTITION BY term))) + 1) AS w FROM tf),
vectors AS MATERIALIZED (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM raw)"""


@query("rec10_tfidf", f"WITH {TFIDF} SELECT item_id, term, round(weight, 8) AS weight FROM vectors")
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rec.tfidf(items(spark, sf)), "weight", digits=8)


PROFILE = "profile AS MATERIALIZED (SELECT user_id, term, sum(weight) / any_value(n) AS weight FROM ratings JOIN vectors USING (item_id) JOIN (SELECT user_id, count(*) AS n FROM ratings GROUP BY 1) USING (user_id) GROUP BY user_id, term)"


@query("rec12_user_profile", f"WITH {RATINGS_SQL}, {TFIDF}, {PROFILE} SELECT user_id, term, round(weight, 8) AS weight FROM profile")
def profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rec.user_profile(ratings(spark, sf), rec.tfidf(items(spark, sf))), "weight", digits=8)


CONTENT = """content AS MATERIALIZED (SELECT user_id, item_id, dot / norm AS score FROM (SELECT user_id, item_id, sum(p.weight * v.weight) AS dot FROM profile p SEMI JOIN active USING (user_id) JOIN vectors v USING (term) GROUP BY ALL)
JOIN (SELECT user_id, sqrt(sum(weight * weight)) AS norm FROM profile GROUP BY 1) USING (user_id))"""


def target_scores(spark: SparkSession, sf: str, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ratings, item vectors, the evaluated users or every one, their content scores)."""
    rows, vectors = held(spark, sf), rec.tfidf(items(spark, sf))
    users = rows.select("user_id").distinct() if every else rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").orderBy("user_id").limit(100).select("user_id")
    own = rec.user_profile(rows, vectors).join(F.broadcast(users), "user_id", "left_semi")
    return rows, vectors, users, rec.content_scores(own, vectors)


@query("rec13_content_topk", f"WITH {RATINGS_SQL}, {HOLDOUT}, {TFIDF}, {PROFILE}, {CONTENT} SELECT user_id, item_id, round(score, 8) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 8) DESC, item_id) AS INTEGER) AS rank FROM content QUALIFY rank <= 5")
def content(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    if every:
        return rec.content_topk(ratings(spark, sf), items(spark, sf), 5)
    return rec.ranked(target_scores(spark, sf)[3], "user_id", "score", "item_id", 5)


@query("rec15_hybrid_topk", f"""WITH {RATINGS_SQL}, {HOLDOUT}, {USER_SCORES}, {TFIDF}, {PROFILE}, {CONTENT},
cf AS (SELECT user_id, item_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-9) AS c FROM scores WHERE score > 0 WINDOW w AS (PARTITION BY user_id)),
h AS (SELECT user_id, item_id, round(0.85 * coalesce(c, 0) + 0.15 * (coalesce(score, 0) + 1) / 2, 8) AS score FROM (SELECT user_id, item_id FROM active CROSS JOIN items) LEFT JOIN cf USING (user_id, item_id) LEFT JOIN content USING (user_id, item_id) ANTI JOIN ratings USING (user_id, item_id))
SELECT user_id, item_id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 5""")
def hybrid(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    if every:
        return rec.hybrid_topk(held(spark, sf), items(spark, sf), 5, 10, 0.85, 0.15)
    rows, _, users, text = target_scores(spark, sf)
    return rec.unseen_topk(rec.hybrid_scores(rec.user_scores(rows, only=users), text, users, items(spark, sf), 0.85, 0.15), rows)


@query("rec17_hybrid_rating", f"""WITH {RATINGS_SQL}, {HOLDOUT}, {USER_SCORES}, {TFIDF}, {PROFILE}, {CONTENT}
SELECT h.user_id, h.item_id, round(greatest(1, least(5, CASE WHEN s.score > 0 THEN 0.85 * s.score + 0.15 * greatest(1, least(5, 3 + 2 * coalesce(c.score, 0))) ELSE greatest(1, least(5, 3 + 2 * coalesce(c.score, 0))) END)), 8) AS prediction
FROM hidden h LEFT JOIN scores s ON s.user_id = h.user_id AND s.item_id = h.item_id LEFT JOIN content c ON c.user_id = h.user_id AND c.item_id = h.item_id""")
def hybrid_rating(spark: SparkSession, sf: str) -> DataFrame:
    rows = held(spark, sf)
    pairs = materialize(rec.holdout(rows).select("user_id", "item_id"), "pairs")
    vectors = materialize(rec.tfidf(items(spark, sf)), "item-vectors")
    own = rec.user_profile(rows.join(F.broadcast(pairs.select("user_id").distinct()), "user_id", "left_semi"), vectors)
    return rounded(rec.hybrid_rating(pairs, rec.user_scores(rows, only=pairs), rec.content_scores(own, vectors, pairs), 0.85, 0.15), "prediction", digits=8)


POPULAR = """c AS (SELECT item_id, count(*) AS n FROM ratings ANTI JOIN hidden USING (user_id, item_id) GROUP BY 1),
listed AS MATERIALIZED (SELECT user_id, item_id, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS rank FROM (SELECT DISTINCT user_id FROM hidden) CROSS JOIN c
  ANTI JOIN (SELECT user_id, item_id FROM ratings ANTI JOIN hidden USING (user_id, item_id)) t USING (user_id, item_id) QUALIFY rank <= 30)"""


def listed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hidden rows, the other ratings, the popularity lists of the evaluated users)."""
    rows = ratings(spark, sf)
    hidden = rec.holdout(rows)
    train = rows.join(hidden.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return hidden, train, rec.popularity_topk(train, 30).join(hidden.select("user_id").distinct(), "user_id", "left_semi")


@query("met7_rank_metrics", f"""WITH {RATINGS_SQL}, {HOLDOUT}, {POPULAR}, s AS (SELECT user_id, count(*) AS size FROM hidden GROUP BY 1),
g AS (SELECT user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS gain FROM hidden JOIN listed USING (user_id, item_id) GROUP BY 1)
SELECT user_id, round(coalesce(hits, 0) / 30.0, 8) AS precision, round(coalesce(hits, 0) / size, 8) AS recall,
round(coalesce(gain, 0) / list_sum(list_transform(range(1, least(30, size) + 1), lambda i: 1 / log2(i + 1))), 8) AS ndcg FROM s LEFT JOIN g USING (user_id)""")
def rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    hidden, _, lists = listed(spark, sf)
    return rounded(rec.rank_metrics(hidden, lists, 30), "precision", "recall", "ndcg", digits=8)


@query("met11_novelty", f"""WITH {RATINGS_SQL}, {HOLDOUT}, {POPULAR} SELECT user_id, round(avg(-log2(n / (SELECT count(DISTINCT user_id) FROM ratings ANTI JOIN hidden USING (user_id, item_id)))), 8) AS novelty FROM listed GROUP BY user_id""")
def novelty(spark: SparkSession, sf: str) -> DataFrame:
    _, train, lists = listed(spark, sf)
    return rounded(rec.novelty(lists, train), "novelty", digits=8)


@query("met12_diversity", f"""WITH {RATINGS_SQL}, {HOLDOUT}, {POPULAR}, {TFIDF}, p AS (SELECT a.user_id, a.item_id AS i, b.item_id AS j FROM listed a JOIN listed b ON a.user_id = b.user_id AND a.item_id < b.item_id),
d AS (SELECT p.user_id, i, j, 1 - coalesce(sum(v.weight * w.weight), 0) AS d FROM p LEFT JOIN vectors v ON v.item_id = i LEFT JOIN vectors w ON w.item_id = j AND w.term = v.term GROUP BY ALL)
SELECT user_id, round(avg(d), 8) AS diversity FROM d GROUP BY user_id""")
def diversity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rec.diversity(listed(spark, sf)[2], rec.tfidf(items(spark, sf))), "diversity", digits=8)


@query("met10_errors", f"""WITH {RATINGS_SQL}, m AS (SELECT item_id, avg(stars) AS p FROM ratings GROUP BY 1)
SELECT round(sqrt(avg((stars - p) * (stars - p))), 8) AS rmse, round(avg(abs(stars - p)), 8) AS mae FROM ratings JOIN m USING (item_id)""")
def errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = ratings(spark, sf)
    means = rows.groupBy("item_id").agg(F.avg("stars").alias("p"))
    return rounded(rec.errors(rows.join(means, "item_id"), "stars", "p"), "rmse", "mae", digits=8)


@query("rec1_random_topk", f"""WITH {RATINGS_SQL}, {HOLDOUT} SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY md5('42_' || user_id || '_' || item_id), item_id) AS INTEGER) AS rank
FROM (SELECT user_id, item_id FROM active CROSS JOIN (SELECT DISTINCT item_id FROM ratings)) ANTI JOIN ratings USING (user_id, item_id) QUALIFY rank <= 5""")
def random(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    rows = ratings(spark, sf)
    users = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    users = users if every else users.where("n >= 4").orderBy("user_id").limit(100)
    return rec.random_topk(rows, users)


#: The 100 users of the hold-out, and everyone in their place.
ACTIVE = "active AS (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 4 ORDER BY user_id LIMIT 100)"
for _name, _plan in {"rec1_random_topk": random, "rec13_content_topk": content, "rec15_hybrid_topk": hybrid}.items():
    query(f"{_name}_all_users", ORACLE_SQL[_name].replace(ACTIVE, "active AS (SELECT DISTINCT user_id FROM ratings)"))(partial(_plan, every=True))


@query("rec2_popularity_rating", f"""WITH {RATINGS_SQL}, {HOLDOUT} SELECT user_id, item_id, round(coalesce((SELECT avg(stars) FROM ratings r WHERE r.item_id = h.item_id AND NOT EXISTS (SELECT 1 FROM hidden x WHERE x.user_id = r.user_id AND x.item_id = r.item_id)), 3.0), 8) AS prediction FROM hidden h""")
def popularity_rating(spark: SparkSession, sf: str) -> DataFrame:
    rows = ratings(spark, sf)
    pairs = rec.holdout(rows).select("user_id", "item_id")
    return rounded(rec.popularity_rating(pairs, rows.join(pairs, ["user_id", "item_id"], "left_anti")), "prediction", digits=8)


@query("rec14_content_rating", f"""WITH {RATINGS_SQL}, {HOLDOUT}, {TFIDF}, {PROFILE}, {CONTENT}
SELECT h.user_id, h.item_id, round(greatest(1, least(5, 3 + 2 * coalesce(c.score, 0))), 8) AS prediction FROM hidden h LEFT JOIN content c ON c.user_id = h.user_id AND c.item_id = h.item_id""")
def content_rating(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, _, text = target_scores(spark, sf)
    return rounded(rec.content_rating(rec.holdout(rows).select("user_id", "item_id"), text), "prediction", digits=8)


CENTRED = """raw_profile AS (SELECT user_id, term, sum((stars - 3) * weight) AS w FROM train SEMI JOIN people USING (user_id) JOIN vectors USING (item_id) GROUP BY user_id, term),
profile AS MATERIALIZED (SELECT user_id, term, CASE WHEN n > 0 THEN w / n ELSE 0 END AS weight FROM raw_profile JOIN (SELECT user_id, sqrt(sum(w * w)) AS n FROM raw_profile GROUP BY 1) USING (user_id))"""
LOT = "md5('42_' || user_id || '_' || item_id)"


@query("rec19_evaluation", f"""WITH {RATINGS_SQL}, {HOLDOUT}, train AS MATERIALIZED (SELECT user_id, item_id, stars FROM ratings ANTI JOIN hidden USING (user_id, item_id)), people AS MATERIALIZED (SELECT DISTINCT user_id FROM hidden),
{USER_SCORES.replace("ratings", "train").replace("<= 10)", "<= 20)")}, {TFIDF}, {CENTRED}, {CONTENT.replace("active", "people").replace("GROUP BY 1)", "GROUP BY 1 HAVING sum(weight * weight) > 0)")},
cf AS (SELECT user_id, item_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-9) AS c FROM scores SEMI JOIN people USING (user_id) WHERE score > 0 WINDOW w AS (PARTITION BY user_id)),
mix AS (SELECT user_id, item_id, round(0.85 * coalesce(c, 0) + 0.15 * (coalesce(score, 0) + 1) / 2, 8) AS score FROM (SELECT user_id, item_id FROM people CROSS JOIN items) LEFT JOIN cf USING (user_id, item_id) LEFT JOIN content USING (user_id, item_id) ANTI JOIN train USING (user_id, item_id)),
sold AS (SELECT item_id, count(*) AS n FROM train GROUP BY 1), unseen AS (SELECT user_id, item_id, n FROM people CROSS JOIN sold ANTI JOIN train USING (user_id, item_id)),
lists AS MATERIALIZED (SELECT 'hybrid' AS model, user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM mix QUALIFY rank <= 30
  UNION ALL SELECT 'popularity', user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS rank FROM unseen QUALIFY rank <= 30
  UNION ALL SELECT 'random', user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {LOT}, item_id) AS rank FROM unseen QUALIFY rank <= 30),
guesses AS (SELECT h.user_id, h.item_id, h.stars, greatest(1, least(5, 3 + 2 * coalesce(t.score, 0))) AS text, s.score AS c,
  coalesce((SELECT avg(stars) FROM train r WHERE r.item_id = h.item_id), 3.0) AS mean, 1 + 4 * (CAST('0x' || substr(md5('42_' || h.user_id || '_' || h.item_id), 1, 8) AS BIGINT) / 4294967296.0) AS luck
  FROM hidden h LEFT JOIN scores s ON s.user_id = h.user_id AND s.item_id = h.item_id LEFT JOIN content t ON t.user_id = h.user_id AND t.item_id = h.item_id),
gaps AS (SELECT 'hybrid' AS model, user_id, stars - CASE WHEN c > 0 THEN greatest(1, least(5, 0.85 * c + 0.15 * text)) ELSE text END AS g FROM guesses
  UNION ALL SELECT 'popularity', user_id, stars - mean FROM guesses UNION ALL SELECT 'random', user_id, stars - luck FROM guesses),
wrong AS (SELECT model, user_id, sqrt(avg(g * g)) AS rmse, avg(abs(g)) AS mae FROM gaps GROUP BY ALL),
sizes AS (SELECT user_id, count(*) AS size FROM hidden GROUP BY 1),
found AS (SELECT model, user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS gain FROM hidden JOIN lists USING (user_id, item_id) GROUP BY ALL),
counts AS (SELECT item_id, count(*) AS n FROM ratings GROUP BY 1),
rare AS (SELECT model, user_id, avg(coalesce(-log2(n / (SELECT count(DISTINCT user_id) FROM ratings)), 0)) AS novelty FROM lists LEFT JOIN counts USING (item_id) GROUP BY ALL),
apart AS (SELECT model, user_id, avg(d) AS diversity FROM (SELECT a.model, a.user_id, a.item_id, b.item_id AS other, 1 - coalesce(sum(v.weight * w.weight), 0) AS d
  FROM lists a JOIN lists b ON a.model = b.model AND a.user_id = b.user_id AND a.item_id < b.item_id LEFT JOIN vectors v ON v.item_id = a.item_id LEFT JOIN vectors w ON w.item_id = b.item_id AND w.term = v.term GROUP BY ALL) GROUP BY ALL)
SELECT model, count(*) AS users, round(avg(coalesce(hits, 0) / 30.0), 8) AS precision, round(avg(coalesce(hits, 0) / size), 8) AS recall,
round(avg(coalesce(gain, 0) / list_sum(list_transform(range(1, least(30, size) + 1), lambda i: 1 / log2(i + 1)))), 8) AS ndcg,
round(avg(rmse), 8) AS rmse, round(avg(mae), 8) AS mae, round(avg(coalesce(novelty, 0)), 8) AS novelty, round(avg(coalesce(diversity, 0)), 8) AS diversity
FROM sizes JOIN wrong USING (user_id) LEFT JOIN found USING (model, user_id) LEFT JOIN rare USING (model, user_id) LEFT JOIN apart USING (model, user_id) GROUP BY model""")
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    rows = held(spark, sf)
    return rounded(rec.evaluate(rec.holdout(rows), rows, items(spark, sf)), *rec.MEASURES, digits=8)
