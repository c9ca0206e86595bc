"""Graph queries with their oracles.

Queries named after an operator alone are those of their SQL: over five-star
reviews, iterative ones for a fixed number of rounds on both sides. Those named
_all_reviews run over the whole graph; PageRank and HITS there, and Louvain,
have no SQL and run with the operators' own settings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minewright.operators import graph
from minewright.operators.components import connected_components
from minewright.plans.exploration import rounded
from minewright.plans.registry import ORACLE_SQL, query
from minewright.runtime import table
from minewright.sources.datasets import ALL_EDGES_SQL, EDGES_SQL, USEFUL_EDGES_SQL, edges

View = Callable[[SparkSession, str], DataFrame]

LINKS_SQL = "links AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), nodes AS MATERIALIZED (SELECT DISTINCT src AS node FROM links)"
NATION_SQL = """partition AS (SELECT 'U_' || c_custkey AS node, c_nationkey AS community FROM customer
  UNION ALL SELECT 'P_' || p_partkey, CAST(p_partkey % 25 AS INTEGER) FROM part)"""


def five_star(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf, stars=5)


def useful_five_star(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf, stars=5, useful_only=True)


def unrolled(first: str, step: str, rounds: int, name: str) -> str:
    """CTEs name0..name<rounds>, each made from the one before ({prev} in step)."""
    parts = [f"{name}0 AS MATERIALIZED ({first})"]
    parts += [f"{name}{i} AS MATERIALIZED ({step.format(prev=f'{name}{i - 1}')})" for i in range(1, rounds + 1)]
    return ",\n".join(parts)


def nation_partition(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "customer").select(F.concat(F.lit("U_"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_nationkey").alias("community"))
    parts = table(spark, sf, "part").select(F.concat(F.lit("P_"), F.col("p_partkey").cast("string")).alias("node"), (F.col("p_partkey") % 25).cast("int").alias("community"))
    return users.union(parts)


@query("gra2_bipartite_edges", f"WITH {EDGES_SQL} SELECT src, dst FROM edges")
def bipartite_edges(spark: SparkSession, sf: str, view: View = five_star) -> DataFrame:
    return view(spark, sf)


@query("gra3_graph_metrics", f"""WITH {EDGES_SQL}, s AS (SELECT count(DISTINCT src) AS users, count(DISTINCT dst) AS items, count(*) AS edges FROM edges)
SELECT users, items, edges, round(2.0 * edges / ((users + items) * (users + items - 1)), 10) AS density, round(edges / (users * items), 10) AS bipartite_density FROM s""")
def graph_metrics(spark: SparkSession, sf: str, view: View = five_star) -> DataFrame:
    return rounded(graph.graph_metrics(view(spark, sf)), "density", "bipartite_density", digits=10)


@query("gra6_components", f"""WITH {USEFUL_EDGES_SQL}, {LINKS_SQL},
{unrolled("SELECT node, node AS c FROM nodes", "SELECT p.node, least(min(p.c), min(q.c)) AS c FROM {prev} p JOIN links ON src = p.node JOIN {prev} q ON q.node = dst GROUP BY p.node", 60, "l")}
SELECT node, c AS component FROM l60""")
def components(spark: SparkSession, sf: str, view: View = useful_five_star) -> DataFrame:
    return connected_components(view(spark, sf))


@query("gra8_bfs_levels", f"""WITH {EDGES_SQL}, {LINKS_SQL},
{unrolled("SELECT node AS source, node, 0 AS distance FROM (SELECT node FROM nodes WHERE node LIKE 'U_%' ORDER BY node LIMIT 3)",
          "SELECT source, node, min(distance) AS distance FROM (SELECT * FROM {prev} UNION ALL SELECT source, dst, distance + 1 FROM {prev} JOIN links ON src = node) GROUP BY source, node", 16, "d")}
SELECT source, node, CAST(distance AS INTEGER) AS distance FROM d16""")
def bfs_levels(spark: SparkSession, sf: str, view: View = five_star) -> DataFrame:
    graph_edges = view(spark, sf)
    start = graph.nodes_of(graph_edges).where(F.col("node").startswith("U_")).orderBy("node").limit(3)
    return graph.bfs_levels(graph_edges, start)


def pagerank_sql(links: str, rounds: int) -> str:
    return f"""WITH {EDGES_SQL}, {LINKS_SQL}, outs AS MATERIALIZED (SELECT src, count(*) AS o FROM {links} GROUP BY src), n AS MATERIALIZED (SELECT count(*) AS n FROM nodes),
{unrolled("SELECT node, 1.0::DOUBLE / n AS s FROM nodes, n",
          "SELECT a.node, 0.15 / n.n + 0.85 * (SELECT coalesce(sum(s), 0) FROM {prev} WHERE node NOT IN (SELECT src FROM outs)) / n.n + 0.85 * coalesce(g.got, 0) AS s "
          "FROM nodes a CROSS JOIN n LEFT JOIN (SELECT dst, sum(s / o) AS got FROM {prev} JOIN outs ON outs.src = node JOIN " + links + " e ON e.src = node GROUP BY dst) g ON g.dst = a.node", rounds, "p")}
SELECT node, round(s, 10) AS score FROM p{rounds}"""


@query("gra10_pagerank_undirected", pagerank_sql("links", 10))
def pagerank_undirected(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.pagerank(five_star(spark, sf), max_iter=10, tol=None), "score", digits=10)


@query("gra11_pagerank_directed", pagerank_sql("edges", 10))
def pagerank_directed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.pagerank(five_star(spark, sf), directed=True, max_iter=10, tol=None), "score", digits=10)


@query("gra12_hits", f"""WITH {EDGES_SQL}, {LINKS_SQL},
{unrolled("SELECT node, 1.0::DOUBLE AS h, 1.0::DOUBLE AS a FROM nodes",
          "SELECT node, h / sqrt(sum(h * h) OVER ()) AS h, a / sqrt(sum(a * a) OVER ()) AS a FROM (SELECT n.node, coalesce(x.h, 0) AS h, coalesce(y.a, 0) AS a FROM nodes n "
          "LEFT JOIN (SELECT src, sum(a) AS h FROM edges JOIN {prev} ON node = dst GROUP BY src) x ON x.src = n.node "
          "LEFT JOIN (SELECT dst, sum(h) AS a FROM edges JOIN {prev} ON node = src GROUP BY dst) y ON y.dst = n.node)", 10, "t")}
SELECT node, round(h, 8) AS hub, round(a, 8) AS authority FROM t10""")
def hits(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.hits(five_star(spark, sf), directed=True, max_iter=10, tol=None), "hub", "authority", digits=8)


@query("gra14_community_subgraph", f"""WITH {EDGES_SQL}, {LINKS_SQL}, {NATION_SQL}, top AS (SELECT community FROM partition GROUP BY 1 ORDER BY count(*) DESC, community LIMIT 5),
picked AS (SELECT node FROM partition SEMI JOIN top USING (community) JOIN (SELECT src AS node, count(*) AS d FROM links GROUP BY 1) USING (node)
  QUALIFY row_number() OVER (PARTITION BY community ORDER BY d DESC, node) <= 50)
SELECT src, dst FROM edges WHERE src IN (SELECT node FROM picked) AND dst IN (SELECT node FROM picked)""")
def community_subgraph(spark: SparkSession, sf: str, view: View = five_star) -> DataFrame:
    return graph.community_subgraph(view(spark, sf), nation_partition(spark, sf))[1].select("src", "dst")


@query("gra15_rank_compare", f"""WITH {EDGES_SQL}, u AS (SELECT src AS node, count(*) AS d FROM edges GROUP BY 1),
v AS (SELECT 'U_' || c_custkey AS node, c_acctbal AS b FROM customer),
r AS (SELECT node, row_number() OVER (ORDER BY d DESC, node) AS ra, row_number() OVER (ORDER BY b DESC, node) AS rb FROM u JOIN v USING (node))
SELECT count(*) AS n, round(1 - 6.0 * sum((ra - rb) * (ra - rb)) / (count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1)), 8) AS spearman,
round(count(*) FILTER (ra <= 50 AND rb <= 50) / 50.0, 8) AS overlap FROM r""")
def rank_compare(spark: SparkSession, sf: str, view: View = five_star) -> DataFrame:
    one = view(spark, sf).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    two = table(spark, sf, "customer").select(F.concat(F.lit("U_"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_acctbal").alias("score"))
    return rounded(graph.compare_rankings(one, two.join(one.select("node"), "node", "left_semi")), "spearman", "overlap", digits=8)


@query("gra16_community_profile", f"""WITH {EDGES_SQL}, {NATION_SQL}, p AS (SELECT community, count(*) FILTER (node LIKE 'U%') AS users, count(*) FILTER (node LIKE 'P%') AS items FROM partition GROUP BY 1),
e AS (SELECT a.community AS x, b.community AS y FROM edges JOIN partition a ON src = a.node JOIN partition b ON dst = b.node)
SELECT community, users, items, (SELECT count(*) FROM e WHERE x = community AND y = community) AS internal, (SELECT count(*) FROM e WHERE x <> y AND (x = community OR y = community)) AS crossing,
round(CASE WHEN users * items > 0 THEN (SELECT count(*) FROM e WHERE x = community AND y = community) / (users * items) ELSE 0 END, 10) AS density FROM p""")
def community_profile(spark: SparkSession, sf: str, view: View = five_star) -> DataFrame:
    return rounded(graph.community_profile(view(spark, sf), nation_partition(spark, sf)), "density", digits=10)


@query("gra17_k_core", f"""WITH {EDGES_SQL},
{unrolled("SELECT src, dst FROM edges", "SELECT src, dst FROM {prev} WHERE src IN (SELECT src FROM {prev} GROUP BY src HAVING count(*) >= 4) AND dst IN (SELECT dst FROM {prev} GROUP BY dst HAVING count(*) >= 4)", 30, "k")}
SELECT src, dst FROM k30""")
def k_core(spark: SparkSession, sf: str, view: View = five_star) -> DataFrame:
    return graph.k_core(view(spark, sf), 4)


@query("gra18_modularity", f"""WITH {EDGES_SQL}, {LINKS_SQL}, {NATION_SQL}, e AS (SELECT a.community AS x, b.community AS y FROM links JOIN partition a ON src = a.node JOIN partition b ON dst = b.node),
c AS (SELECT x, count(*) AS tot, count(*) FILTER (x = y) AS inside FROM e GROUP BY x), m AS (SELECT CAST(sum(tot) AS DOUBLE) AS m2 FROM c)
SELECT round(sum(inside / m2 - (tot / m2) * (tot / m2)), 10) AS modularity FROM c, m""")
def modularity(spark: SparkSession, sf: str, view: View = five_star) -> DataFrame:
    return rounded(graph.modularity(view(spark, sf), nation_partition(spark, sf)), "modularity", digits=10)


@query("gra13_louvain")
def louvain(spark: SparkSession, sf: str) -> DataFrame:
    return graph.louvain(edges(spark, sf), rounds=1000)[0]


WHOLE = {
    "gra2_bipartite_edges": bipartite_edges,
    "gra3_graph_metrics": graph_metrics,
    "gra6_components": components,
    "gra8_bfs_levels": bfs_levels,
    "gra14_community_subgraph": community_subgraph,
    "gra15_rank_compare": rank_compare,
    "gra16_community_profile": community_profile,
    "gra17_k_core": k_core,
    "gra18_modularity": modularity,
}
for _name, _plan in WHOLE.items():
    query(f"{_name}_all_reviews", ORACLE_SQL[_name].replace(USEFUL_EDGES_SQL, ALL_EDGES_SQL).replace(EDGES_SQL, ALL_EDGES_SQL))(partial(_plan, view=edges))


@query("gra10_pagerank_undirected_all_reviews")
def pagerank_undirected_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.pagerank(edges(spark, sf)), "score", digits=10)


@query("gra11_pagerank_directed_all_reviews")
def pagerank_directed_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.pagerank(edges(spark, sf), directed=True), "score", digits=10)


@query("gra12_hits_all_reviews")
def hits_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.hits(edges(spark, sf), directed=True), "hub", "authority", digits=8)


@query("gra7_giant_component", f"""WITH {USEFUL_EDGES_SQL}, {LINKS_SQL},
{unrolled("SELECT node, node AS c FROM nodes", "SELECT p.node, least(min(p.c), min(q.c)) AS c FROM {prev} p JOIN links ON src = p.node JOIN {prev} q ON q.node = dst GROUP BY p.node", 60, "l")}
SELECT max(n) AS size, round(100.0 * max(n) / sum(n), 8) AS share FROM (SELECT c, count(*) AS n FROM l60 GROUP BY c)""")
def giant_component(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.giant_component(connected_components(useful_five_star(spark, sf))), "share", digits=8)


@query("top1_items", f"""WITH {EDGES_SQL}, d AS (SELECT dst AS node, count(*) AS score FROM edges GROUP BY 1 ORDER BY score DESC, node LIMIT 10)
SELECT node, score, coalesce(p_name, 'unknown') AS name FROM d LEFT JOIN part ON node = 'P_' || p_partkey AND p_partkey % 2 = 0""")
def top_items(spark: SparkSession, sf: str) -> DataFrame:
    scores = five_star(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("score"))
    # Names are known for half of the items, so that the default is met.
    parts = table(spark, sf, "part").where("p_partkey % 2 = 0")
    return graph.top_nodes(scores, parts.select(F.concat(F.lit("P_"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_name").alias("name")))


def sweep_sql(start: str, name: str) -> str:
    return unrolled(
        f"SELECT node AS source, node, 0 AS distance FROM {start}",
        "SELECT source, node, min(distance) AS distance FROM (SELECT * FROM {prev} UNION ALL SELECT source, dst, distance + 1 FROM {prev} JOIN links ON src = node) GROUP BY source, node",
        16,
        name,
    )


@query("gra9_diameter", f"""WITH {EDGES_SQL}, {LINKS_SQL}, drawn AS (SELECT node FROM nodes ORDER BY md5('42_' || node), node LIMIT 10),
{sweep_sql("drawn", "s")}, ends AS MATERIALIZED (SELECT DISTINCT node FROM (SELECT node, row_number() OVER (PARTITION BY source ORDER BY distance DESC, node DESC) AS r FROM s16) WHERE r = 1),
{sweep_sql("ends", "t")}
SELECT CAST(max(distance) AS INTEGER) AS diameter FROM t16""")
def diameter(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(graph.diameter(five_star(spark, sf), method="approximate"),)], "diameter int")
