"""Feature, clustering and decomposition queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minewright.functions import features
from minewright.operators import bfr, clustering as clu
from minewright.operators.decomposition import Pca, Svd, covariance
from minewright.operators.vectors import stack
from minewright.plans.exploration import rounded
from minewright.plans.registry import query
from minewright.runtime import table
from minewright.sources.datasets import ITEMS_SQL, REVIEWS_SQL, items, reviews

POINTS = "points AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
LONG = POINTS + ", long AS MATERIALIZED (SELECT id, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM points)"
PAIRS = POINTS + ", pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, array_distance(CAST(a.v AS DOUBLE[64]), CAST(b.v AS DOUBLE[64])) AS d FROM points a CROSS JOIN points b)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query("fea2_standardise", f"""WITH {LONG}, s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY i)
SELECT id, CAST(i AS INTEGER) AS i, round((x - m) / s, 8) AS z FROM long JOIN s USING (i)""")
def standardise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clu.standardise(points(spark, sf)).select("id", F.posexplode("v").alias("i", "z")), "z", digits=8)


@query("dim1_covariance", f"""WITH {LONG}, s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY i), z AS MATERIALIZED (SELECT id, i, (x - m) / s AS z FROM long JOIN s USING (i))
SELECT CAST(p.i AS INTEGER) AS i, CAST(q.i AS INTEGER) AS j, round(sum(p.z * q.z) / ((SELECT count(*) FROM points) - 1), 8) AS value FROM z p JOIN z q ON p.id = q.id AND p.i <= q.i GROUP BY ALL""")
def feature_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(covariance(points(spark, sf)), "value", digits=8)


@query("clu1_lloyd_step", f"""WITH {POINTS}, c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, v AS cv FROM points ORDER BY id LIMIT 10),
n AS (SELECT id, arg_min(c, d) AS c FROM (SELECT id, c, array_distance(CAST(v AS DOUBLE[64]), CAST(cv AS DOUBLE[64])) AS d FROM points CROSS JOIN c) GROUP BY id)
SELECT CAST(c AS INTEGER) AS cluster, CAST(i AS INTEGER) AS i, round(avg(x), 8) AS x FROM (SELECT id, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM points) JOIN n USING (id) GROUP BY ALL""")
def lloyd_step(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf)
    centres, _ = clu.lloyd_step(rows, stack(rows.orderBy("id").limit(10).toPandas()["v"]))
    long = [(c, i, float(x)) for c, row in enumerate(centres) for i, x in enumerate(row)]
    return rounded(spark.createDataFrame(long, "cluster int, i int, x double"), "x", digits=8)


@query("clu3_dbscan_single_hop")
def dbscan_single_hop(spark: SparkSession, sf: str) -> DataFrame:
    return clu.dbscan(points(spark, sf), 1.2, 5, "single_hop")


@query("clu3_eps_links", f"WITH {PAIRS} SELECT a AS id, count(*) AS n FROM pairs WHERE d <= 1.2 GROUP BY a")
def eps_degree(spark: SparkSession, sf: str) -> DataFrame:
    return clu.eps_links(points(spark, sf), 1.2).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("clu3_dbscan_density", f"""WITH {PAIRS}, links AS MATERIALIZED (SELECT a, b FROM pairs WHERE d <= 1.2), core AS MATERIALIZED (SELECT a AS id FROM links GROUP BY a HAVING count(*) >= 5),
inner_links AS MATERIALIZED (SELECT a, b FROM links WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
l0 AS MATERIALIZED (SELECT id, id AS c FROM core), """ + ", ".join(f"l{i} AS MATERIALIZED (SELECT a AS id, min(c) AS c FROM inner_links JOIN l{i - 1} ON id = b GROUP BY a)" for i in range(1, 31))
       + """ SELECT p.id, coalesce(o.c, (SELECT min(c) FROM links JOIN l30 x ON x.id = b WHERE a = p.id), -1) AS label FROM points p LEFT JOIN l30 o ON o.id = p.id""")
def dbscan_density(spark: SparkSession, sf: str) -> DataFrame:
    return clu.dbscan(points(spark, sf), 1.2, 5)


@query("met1_silhouette", f"""WITH {PAIRS}, m AS (SELECT a, la, lb, avg(d) AS d FROM pairs GROUP BY ALL), s AS (SELECT a, max(d) FILTER (la = lb) AS p, min(d) FILTER (la <> lb) AS q FROM m GROUP BY a)
SELECT round(avg((q - p) / greatest(p, q)), 8) AS silhouette FROM s""")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clu.silhouette(points(spark, sf)), "silhouette", digits=8)


LABELLED = "r AS (SELECT doc_id, quality AS t, CAST(doc_id % 4 AS INTEGER) - 1 AS l FROM labels)"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("quality").alias("true"), ((F.col("doc_id") % 4).cast("int") - 1).alias("label"))


@query("met2_purity", f"WITH {LABELLED} SELECT round((SELECT sum(m) FROM (SELECT max(n) AS m FROM (SELECT l, t, count(*) AS n FROM r WHERE l >= 0 GROUP BY ALL) GROUP BY l)) / count(*), 8) AS purity FROM r")
def purity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clu.purity(labelled(spark, sf)), "purity", digits=8)


@query("met4_nmi", f"""WITH {LABELLED}, c AS (SELECT t, l, CAST(count(*) AS DOUBLE) AS n FROM r WHERE l >= 0 GROUP BY ALL), m AS (SELECT n, sum(n) OVER (PARTITION BY t) AS nt, sum(n) OVER (PARTITION BY l) AS nl, sum(n) OVER () AS s FROM c)
SELECT round(2 * sum(n / s * ln(n * s / (nt * nl))) / (sum(-n / s * ln(nt / s)) + sum(-n / s * ln(nl / s))), 8) AS nmi FROM m""")
def nmi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clu.nmi(labelled(spark, sf)), "nmi", digits=8)


@query("met5_k_distance", f"WITH {PAIRS} SELECT a AS id, round(d, 8) AS distance FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = 11")
def k_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clu.k_distance(points(spark, sf), 10), "distance", digits=8)


@query("clu1_kmeans")
def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return clu.kmeans(points(spark, sf), 10, n_init=10)[1]


@query("clu4_cure")
def cure(spark: SparkSession, sf: str) -> DataFrame:
    return clu.cure(points(spark, sf), 10)


@query("dim2_pca")
def pca(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf)
    return Pca(0.9).fit(rows).transform(rows)


@query("dim7_svd_errors")
def svd_errors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(Svd().fit(points(spark, sf)).errors([1, 2, 4, 8, 16, 32, 64]), "k int, error double")


@query("met3_entropy", "SELECT round(-sum(p * ln(p)), 8) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label)")
def label_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clu.entropy(points(spark, sf)), "entropy", digits=8)


@query("fea1_feature_matrix", f"""WITH {REVIEWS_SQL}, {ITEMS_SQL}, top AS MATERIALIZED (SELECT item_id, avg(stars) AS stars, count(*) AS n, any_value(categories) AS categories FROM reviews JOIN items USING (item_id) GROUP BY item_id ORDER BY n DESC, item_id LIMIT 1500),
own AS MATERIALIZED (SELECT DISTINCT item_id, trim(name) AS name FROM (SELECT item_id, unnest(string_split(categories, ',')) AS name FROM top) WHERE trim(name) <> ''),
names AS (SELECT name, 1 + row_number() OVER (ORDER BY count(*) DESC, name) AS i FROM own GROUP BY name QUALIFY i <= 21)
SELECT item_id AS id, CAST(i AS INTEGER) AS i, round(x, 8) AS x, CAST(floor(stars) - 1 AS INTEGER) AS label FROM top JOIN (
  SELECT item_id, 0 AS i, stars AS x FROM top UNION ALL SELECT item_id, 1, ln(1 + n) FROM top
  UNION ALL SELECT t.item_id, i, CASE WHEN o.name IS NULL THEN 0 ELSE 1 END FROM top t CROSS JOIN names LEFT JOIN own o ON o.item_id = t.item_id AND o.name = names.name) USING (item_id)""")
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.feature_matrix(items(spark, sf), reviews(spark, sf))
    return rounded(rows.select("id", "label", F.posexplode("v").alias("i", "x")), "x", digits=8)


TOP_ITEMS = f"""{REVIEWS_SQL}, {ITEMS_SQL}, top AS MATERIALIZED (SELECT item_id, avg(stars) AS stars, count(*) AS n, any_value(categories) AS categories, CAST(floor(avg(stars)) - 1 AS INTEGER) AS label
  FROM reviews JOIN items USING (item_id) GROUP BY item_id ORDER BY n DESC, item_id LIMIT 1500),
cats AS MATERIALIZED (SELECT item_id, label, trim(name) AS category FROM (SELECT item_id, label, unnest(string_split(categories, ',')) AS name FROM top) WHERE trim(name) <> '')"""


@query("eda14_cluster_means", f"""WITH {TOP_ITEMS}, own AS MATERIALIZED (SELECT DISTINCT item_id, category FROM cats), names AS (SELECT category, 1 + row_number() OVER (ORDER BY count(*) DESC, category) AS i FROM own GROUP BY category QUALIFY i <= 21)
SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 8) AS mean FROM (
  SELECT label, 0 AS i, stars AS x FROM top UNION ALL SELECT label, 1, ln(1 + n) FROM top
  UNION ALL SELECT t.label, i, CASE WHEN o.category IS NULL THEN 0 ELSE 1 END FROM top t CROSS JOIN names LEFT JOIN own o ON o.item_id = t.item_id AND o.category = names.category) GROUP BY ALL""")
def cluster_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.feature_matrix(items(spark, sf), reviews(spark, sf))
    return rounded(features.cluster_means(rows, rows), "mean", digits=8)


@query("eda15_cluster_profile", f"""WITH {TOP_ITEMS}, s AS (SELECT label, count(*) AS size, avg(stars) AS stars, avg(n) AS reviews FROM top GROUP BY 1)
SELECT label, size, round(stars, 8) AS stars, round(reviews, 8) AS reviews, CAST(row_number() OVER (PARTITION BY label ORDER BY m DESC, category) AS INTEGER) AS rank, category, m AS n, round(m / size, 8) AS share
FROM s JOIN (SELECT label, category, count(*) AS m FROM cats GROUP BY ALL) USING (label) QUALIFY rank <= 3""")
def cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    rated = reviews(spark, sf).groupBy("item_id").agg(F.avg("stars").alias("stars"), F.count(F.lit(1)).alias("reviews"))
    rows = items(spark, sf).join(rated, "item_id").withColumnRenamed("item_id", "id")
    labels = features.feature_matrix(items(spark, sf), reviews(spark, sf)).select("id", "label")
    return rounded(features.cluster_profile(rows, labels), "stars", "reviews", "share", digits=8)


@query("clu7_cluster_sums", f"WITH {LONG} SELECT p.label, CAST(i AS INTEGER) AS i, count(*) AS n, round(sum(x), 8) AS s, round(sum(x * x), 8) AS q FROM long JOIN points p USING (id) GROUP BY ALL")
def cluster_sums(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf)
    return rounded(bfr.summaries(rows, rows), "s", "q", digits=8)


@query("clu6_mahalanobis", f"""WITH {LONG}, s AS (SELECT p.label, i, count(*) AS n, avg(x) AS m, avg(x * x) - avg(x) * avg(x) AS v FROM long JOIN points p USING (id) GROUP BY ALL)
SELECT id, s.label, round(CASE WHEN any_value(n) <= 1 THEN 'inf'::DOUBLE ELSE sqrt(sum((x - m) * (x - m) / CASE WHEN v <= 0 THEN 1e-6 ELSE v END)) END, 5) AS distance FROM long JOIN s USING (i) GROUP BY id, s.label""")
def mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf)
    return rounded(bfr.mahalanobis(rows, bfr.summaries(rows, rows)), "distance", digits=5)


@query("clu5_bfr")
def bfr_labels(spark: SparkSession, sf: str) -> DataFrame:
    return bfr.bfr(points(spark, sf), 10, threshold=12.0)


@query("clu2_elbow")
def elbow(spark: SparkSession, sf: str) -> DataFrame:
    return clu.elbow(points(spark, sf), range(5, 50, 5))


@query("met6_silhouette_by_k")
def silhouette_by_k(spark: SparkSession, sf: str) -> DataFrame:
    return clu.silhouette_by_k(points(spark, sf), range(2, 11), {"cure": clu.cure, "bfr": lambda rows, k: bfr.bfr(rows, k, threshold=12.0)})
