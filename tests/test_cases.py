"""Small cases with known results, and brute-force versions of what SQL can't express."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from minewright.operators import bfr, blocks, clustering, eda, graph, recommend, slices
from minewright.operators.components import connected_components
from minewright.operators.decomposition import Svd
from minewright.plans import registry
from minewright.sources import jsonl
from minewright.sources.datasets import ratings
from minewright.functions import features
from minewright.streaming import dgim, sketches, windows


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "src string, dst string").distinct()


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in np.atleast_1d(v)]) for i, v in enumerate(rows)], "id long, v array<double>")


def test_graph_metrics_and_components(spark):
    g = edges(spark, ("U_A", "P_x"), ("U_A", "P_y"), ("U_B", "P_y"), ("U_C", "P_z"), ("U_A", "P_x"))
    row = graph.graph_metrics(g).first()
    assert (row.users, row.items, row.edges) == (3, 3, 4)
    assert row.density == pytest.approx(8 / 30) and row.bipartite_density == pytest.approx(4 / 9)
    sizes = sorted(r["count"] for r in connected_components(g).groupBy("component").count().collect())
    assert sizes == [2, 4]
    assert graph.diameter(g, method="exact") == 3
    assert graph.diameter(g, method="approximate") == 3
    with pytest.raises(ValueError):
        graph.diameter(g, method="other")


def test_hits_first_round(spark):
    g = edges(spark, ("A", "x"), ("A", "y"), ("B", "y"))
    got = {r.node: r for r in graph.hits(g, directed=True, max_iter=1, tol=None).collect()}
    assert got["y"].authority == pytest.approx(2 / math.sqrt(5)) and got["A"].hub == pytest.approx(2 / math.sqrt(5))
    assert got["A"].authority == 0 and got["x"].hub == 0


def test_k_core(spark):
    g = edges(spark, ("A", "x"), ("A", "y"), ("B", "x"), ("B", "y"), ("C", "x"))
    assert {(r.src, r.dst) for r in graph.k_core(g, 2).collect()} == {("A", "x"), ("A", "y"), ("B", "x"), ("B", "y")}
    assert graph.k_core(g, 3).count() == 0


def test_louvain_finds_two_blocks(spark):
    pairs = [(f"U_{b}{i}", f"P_{b}{j}") for b in "ab" for i in range(4) for j in range(4)] + [("U_a0", "P_b0")]
    part, q = graph.louvain(edges(spark, *pairs))
    groups = {}
    for r in part.collect():
        groups.setdefault(r.community, set()).add(r.node[2])
    assert all(len(x) == 1 for x in groups.values())
    assert q == pytest.approx(graph.modularity(edges(spark, *pairs), part).first()[0]) and q > 0.2


def test_elbow(spark):
    curve = spark.createDataFrame([(1, 100.0), (2, 40.0), (3, 20.0), (4, 10.0)], "k int, y double")
    assert eda.elbow(curve, "k", "y").first().x == 2.0


def test_similarity_and_metrics(spark):
    r = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (2, 1, 4.0), (2, 3, 2.0)], "user_id long, item_id long, stars double")
    assert recommend.neighbours(r).where("a = 1").first().sim == pytest.approx(20 / (math.sqrt(34) * math.sqrt(20)), abs=1e-7)
    actual = spark.createDataFrame([(1, 1), (1, 2)], "user_id long, item_id long")
    predicted = spark.createDataFrame([(1, 1, 1), (1, 9, 2)], "user_id long, item_id long, rank int")
    assert recommend.rank_metrics(actual, predicted, 5).first().precision == pytest.approx(0.2)
    late = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "user_id long, item_id long, rank int")
    assert recommend.rank_metrics(actual.where("item_id = 2"), late, 2).first().ndcg == pytest.approx(1 / math.log2(3))


def test_tfidf(spark):
    items = spark.createDataFrame([(1, "a,a,b"), (2, "b"), (3, None)], "item_id long, categories string").where("item_id < 3")
    got = {(r.item_id, r.term): r.weight for r in recommend.tfidf(items).collect()}
    assert got[1, "a"] == pytest.approx(0.942156, abs=1e-6) and got[1, "b"] == pytest.approx(0.335176, abs=1e-6) and got[2, "b"] == 1


def test_cluster_quality(spark):
    rows = points(spark, [0, 1, 10]).withColumn("label", (F.col("id") == 2).cast("int"))
    assert clustering.silhouette(rows).first()[0] == pytest.approx((0.95 + (9 - 0.5) / 9 + 1) / 3, abs=1e-6)
    marks = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, -1)], "true int, label int")
    assert clustering.purity(marks).first()[0] == pytest.approx(0.5)


def test_dbscan_modes(spark):
    chain = points(spark, range(5))
    density = {r.id: r.label for r in clustering.dbscan(chain, 1, 2).collect()}
    hop = {r.id: r.label for r in clustering.dbscan(chain, 1, 2, "single_hop").collect()}
    assert set(density.values()) == {0}
    assert hop == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_clusterers_split_far_groups(spark):
    rows = points(spark, [[x, y] for x in (0, 50) for y in range(6)])
    for labels in (clustering.kmeans(rows, 2)[1], clustering.cure(rows, 2)):
        got = {r.id: r.label for r in labels.collect()}
        assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(12)}) == 2


def test_svd_errors(spark):
    x = np.random.default_rng(1).normal(size=(20, 4))
    svd = Svd().fit(points(spark, x))
    assert np.allclose(svd.singular, np.linalg.svd(x, compute_uv=False))
    assert svd.errors([4])[0][1] == pytest.approx(0, abs=1e-6)


def test_windows_fill_gaps(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-01 00:10:00', 2D), (timestamp_ntz'2024-01-01 02:20:00', 4D) AS t(ts, value)")
    got = windows.window_statistics(df, "1 hour").orderBy("start").collect()
    assert [(r["count"], r["sum"], r.average, r.std) for r in got] == [(1, 2.0, 2.0, None), (0, 0.0, None, None), (1, 4.0, 4.0, None)]


def test_dgim(spark):
    """Buckets against a histogram that merges as ones arrive, at every place of a stream."""
    rng = random.Random(7)
    bits = [int(rng.random() < 0.4) for _ in range(700)]
    rows = spark.createDataFrame([("a", i, b) for i, b in enumerate(bits)] + [("b", i, 1) for i in range(3)] + [("c", 0, None)], "g string, i int, bit int")
    buckets, kept = [], []
    for t, bit in enumerate(bits, 1):
        if bit:
            buckets.insert(0, (t, 1))
            size = 1
            while [s for _, s in buckets].count(size) == 3:
                at = [k for k, (_, s) in enumerate(buckets) if s == size][1:]
                buckets[at[0] : at[1] + 1] = [(buckets[at[0]][0], 2 * size)]
                size *= 2
        kept.append([s for end, s in buckets if end > t - 200])
    got = {r["now"]: (r.estimate, r.exact) for r in dgim.dgim_evaluate(rows.where("g = 'a'"), ["i"], "bit", [200, 10**6], checkpoints=700).collect()}
    assert len(got) == 700
    for t in range(1, 701):
        sizes, exact = kept[t - 1], sum(bits[max(0, t - 200) : t])
        assert got[t] == (sum(sizes) - max(sizes, default=0) / 2, exact) and abs(got[t][0] - exact) <= 0.5 * exact + 1
    ends = {r.grp: (r.estimate, r.buckets, r.bits) for r in dgim.dgim_by_group(rows, "g", ["i"], "bit", 10).collect()}
    assert ends["b"][:2] == (2.0, 2) and ends["c"] == (0.0, 0, 0.0)
    assert 12 * dgim.memory_bits(1000) == pytest.approx(202.51, abs=0.01)
    assert dgim.dgim_by_group(rows.where("false"), "g", ["i"], "bit", 10).count() == 0


def test_sketch_bounds(spark):
    assert sketches.cms_bounds(4, 2000, 27540)["error_bound"] == pytest.approx(37.4307, abs=1e-3)
    with pytest.raises(ValueError):
        sketches.hll_registers(spark.range(3), "id", p=3)


def test_tolerant_json_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n\n{"a": \nbad\n {"a": 2} \n')
    rows, report = jsonl.load_tolerant(spark, str(tmp_path / "x.json"), "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 2]
    assert report.first().asDict() == {"lines": 5, "blank": 1, "corrupt": 2}


def test_json_lines_and_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    jsonl.write_json_lines(df, str(tmp_path / "out"))
    assert jsonl.load_json_lines(spark, str(tmp_path / "out")).count() == 2
    assert jsonl.load_json_lines(spark, str(tmp_path / "out"), max_rows=0).count() == 0
    jsonl.write_web_payload("data", {"part": df.orderBy("id")}, str(tmp_path / "p.js"))
    assert json.loads((tmp_path / "p.js").read_text()[len("const data = ") : -2]) == {"part": {"id": [1, 2], "name": ["a", "b"]}}


def test_stream_windows_match_batch(spark, tmp_path):
    df = spark.range(200).select((F.timestamp_seconds(F.col("id") * 97)).alias("ts"), F.col("id").cast("double").alias("value"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.stream_statistics(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "1 hour")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("stats").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    # Sums of a stream are taken in another order.
    rows = lambda df: sorted((*r[:4], round(r.std, 9), *r[5:]) for r in df.collect())
    assert rows(spark.table("stats")) == rows(windows.window_statistics(df, "1 hour", fill=False))


@pytest.fixture(scope="module")
def review_graph(spark, tmp_path_factory):
    """(folder, pairs): 30 reviews of 8 users, of every number of stars and both flags, and the distinct pairs."""
    home, rng = str(tmp_path_factory.mktemp("reviews")), random.Random(3)
    rows = [(i, 1, f"U_{i % 8}", 1 + (i % 8 + i // 8) % 6 if i < 16 else rng.randint(1, 6), float(1 + i % 50), "RNA"[i % 3]) for i in range(30)]
    lines = [(o, n, int(item), quantity, flag) for o, n, _, item, quantity, flag in rows]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string").withColumn("l_shipdate", F.lit("1995-01-01").cast("date")).write.parquet(f"{home}/lineitem.parquet")
    spark.createDataFrame([(r[0], int(r[2][2:])) for r in rows], "o_orderkey long, o_custkey long").write.parquet(f"{home}/orders.parquet")
    return home, {(r[2], f"P_{r[3]}") for r in rows}


def adjacency(pairs):
    names = sorted({x for p in pairs for x in p})
    a = np.zeros((len(names), len(names)))
    for s, d in pairs:
        a[names.index(s), names.index(d)] = 1
    return names, a


def test_graph_queries_read_all_reviews(spark, review_graph):
    home, pairs = review_graph
    run = lambda name: registry.QUERIES[f"{name}_all_reviews"](spark, home).collect()
    assert {(r.src, r.dst) for r in run("gra2_bipartite_edges")} == pairs
    assert run("gra3_graph_metrics")[0].edges == len(pairs)
    assert {r.node for r in run("gra6_components")} == {r.node for r in registry.QUERIES["gra13_louvain"](spark, home).collect()} == {x for p in pairs for x in p}


@pytest.mark.parametrize("directed", [False, True])
def test_pagerank_of_all_reviews_converges(spark, review_graph, directed):
    home, pairs = review_graph
    names, a = adjacency(pairs)
    a = a if directed else a + a.T
    n, out = len(names), a.sum(1)
    step = np.where(out[:, None] > 0, a / np.maximum(out, 1)[:, None], 1 / n)
    want = np.linalg.solve(np.eye(n) - 0.85 * step.T, np.full(n, 0.15 / n))
    got = {r.node: r.score for r in registry.QUERIES["gra11_pagerank_directed_all_reviews" if directed else "gra10_pagerank_undirected_all_reviews"](spark, home).collect()}
    assert [got[x] for x in names] == pytest.approx(want, abs=1e-5)


def test_hits_of_all_reviews_converges(spark, review_graph):
    home, pairs = review_graph
    names, a = adjacency(pairs)
    u, _, v = np.linalg.svd(a)
    got = {r.node: r for r in registry.QUERIES["gra12_hits_all_reviews"](spark, home).collect()}
    assert [got[x].hub for x in names] == pytest.approx(np.abs(u[:, 0]), abs=1e-4)
    assert [got[x].authority for x in names] == pytest.approx(np.abs(v[0]), abs=1e-4)


def test_louvain_goes_on_until_nothing_moves(spark):
    rng = random.Random(5)
    g = edges(spark, *[(f"U_{rng.randrange(16)}", f"P_{rng.randrange(16)}") for _ in range(160)])
    _, q = graph.louvain(g, rounds=1000)
    assert q > 0.19


def test_registered_settings_are_the_whole_ones(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(clustering, "kmeans", lambda rows, k, **given: seen.update(kmeans=given) or (None, rows, 0.0))
    monkeypatch.setattr(graph, "louvain", lambda links, **given: seen.update(louvain=given) or (links, 0.0))
    registry.QUERIES["clu1_kmeans"](spark, "/root/testdata/sf0.001")
    registry.QUERIES["gra13_louvain"](spark, "/root/testdata/sf0.001")
    assert seen["kmeans"].get("n_init", 1) >= 10 and seen["kmeans"].get("max_iter", 100) >= 100
    assert seen["louvain"].get("max_levels", 10) >= 10 and seen["louvain"].get("rounds", 20) >= 100


@pytest.mark.parametrize("name", ["rec1_random_topk", "rec13_content_topk", "rec15_hybrid_topk"])
def test_all_users_are_served(spark, name):
    folder = "/root/testdata/sf0.001"
    users = {r[0] for r in ratings(spark, folder).select("user_id").distinct().collect()}
    rows = registry.QUERIES[f"{name}_all_users"](spark, folder).groupBy("user_id").count().collect()
    assert {r.user_id for r in rows} == users and all(r["count"] == 5 for r in rows) and len(users) > 100


def test_features_align_by_id(spark):
    one = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id int, v array<double>")
    two = spark.createDataFrame([(2, [5.0, 6.0]), (9, [0.5, 0.5])], "id int, v array<double>")
    assert {r.id: r.v for r in features.concatenate(one, two, 2).collect()} == {1: [1.0, 0.0, 0.0], 2: [2.0, 5.0, 6.0]}
    said = spark.sql("SELECT map('a', 'True', 'b', 'False', 'c', 'free', 'd', null) AS m")
    assert sorted(said.select(features.attribute_tokens(said.m).alias("t")).first().t) == ["a", "c_free"]


def blobs(n=200, seed=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 1.0, (n, 2)) for c in ((0, 0), (40, 0), (0, 40))])


def test_bfr_finds_blobs_in_any_order(spark):
    x = blobs()
    far = [[500.0, 500.0]]
    df = points(spark, [*x, *far])
    got = {r.id: r.label for r in bfr.bfr(df, 3, threshold=5.0).collect()}
    assert len(got) == len(x) + 1
    for b in range(3):
        inside = [got[i] for i in range(200 * b, 200 * b + 200)]
        assert max(inside.count(v) for v in set(inside)) >= 198
    assert len({got[10], got[210], got[410]}) == 3
    again = {r.id: r.label for r in bfr.bfr(df.repartition(7), 3, threshold=5.0).collect()}
    assert again == got
    assert {r.label for r in bfr.bfr(points(spark, x[:2]), 3).collect()} == {-1}
    assert bfr.bfr(points(spark, x).limit(0), 3).count() == 0


def test_bfr_makes_clusters_of_what_the_sample_missed(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1.0, (300, 2)), rng.normal(60, 0.01, (12, 2))])
    got = {r.id: r.label for r in bfr.bfr(points(spark, x), 1, threshold=5.0, micro=2, sample_size=8).collect()}
    late = {got[i] for i in range(300, 312)}
    assert len(late) == 1 and late.isdisjoint({got[i] for i in range(300)}) and -1 not in late


def test_summaries_add_up_and_measure(spark):
    x = blobs(20)
    own = np.repeat(np.arange(3), 20)
    whole = bfr.Summary.of(x, own, 3)
    halves = bfr.Summary.of(x[::2], own[::2], 3) + bfr.Summary.of(x[1::2], own[1::2], 3)
    assert np.allclose(whole.q, halves.q) and np.allclose(whole.s, halves.s) and (whole.n == halves.n).all()
    df, labels = points(spark, x), spark.createDataFrame([(i, int(c)) for i, c in enumerate(own)], "id long, label int")
    want = whole.distances(x)
    for r in bfr.mahalanobis(df, bfr.summaries(df, labels)).collect():
        assert r.distance == pytest.approx(want[r.id, r.label])
    assert np.isinf(bfr.Summary.of(x[:1], own[:1], 1).distances(x)).all()


def test_searches_for_k(spark):
    df = points(spark, blobs(40))
    fall = {r.k: r.inertia for r in clustering.elbow(df, [1, 2, 3], n_init=2).collect()}
    assert fall[1] > fall[2] > 10 * fall[3]
    rows = clustering.silhouette_by_k(df, [2, 3, 4], {"cure": clustering.cure, "bfr": lambda d, k: bfr.bfr(d, k, threshold=5.0)}).collect()
    assert {(r.method, r.k) for r in rows if r.best} == {("cure", 3), ("bfr", 3)}


def test_evaluation_of_odd_input(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0), (2, 1, 4.0), (2, 3, 2.0)], "user_id long, item_id long, stars double")
    things = spark.createDataFrame([(1, "a, b"), (2, "b"), (3, None)], "item_id long, categories string")
    got = {r.model: r for r in recommend.evaluate(rows.where("user_id = 1 and item_id = 1"), rows, things, k=2).collect()}
    # Item 1 is the only one but item 3 that user 1 hasn't rated in the rest, and its mean there is 4.
    assert got["popularity"].users == 1 and got["popularity"].recall == 1 and got["popularity"].rmse == pytest.approx(1)
    assert got["hybrid"].precision == pytest.approx(0.5) and got["random"].recall == 1
    assert [r.users for r in recommend.evaluate(rows.limit(0), rows, things).collect()] == [0, 0, 0]


def some_ratings(spark, users=70, items=40, n=900, seed=6):
    """(table, stars as a matrix, 0 where unrated)."""
    rng = np.random.default_rng(seed)
    stars = np.zeros((users, items))
    stars[rng.integers(users, size=n), rng.integers(items, size=n)] = rng.integers(1, 6, size=n)
    return spark.createDataFrame([(int(u), int(i), float(stars[u, i])) for u, i in np.argwhere(stars)], "user_id long, item_id long, stars double"), stars


def nearest(vectors, has, k):
    """{a: [(b, sim)]} by brute force."""
    norm = np.sqrt((vectors * vectors).sum(1))
    sim = np.round(vectors @ vectors.T / np.outer(norm, norm), 8)
    return {a: sorted(((b, sim[a, b]) for b in range(len(sim)) if b != a and has[a] @ has[b] and sim[a, b] > 0), key=lambda x: (-x[1], x[0]))[:k] for a in range(len(sim))}


def near_rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.a, []).append((r.b, r.sim))
    return {a: sorted(x, key=lambda x: (-x[1], x[0])) for a, x in out.items()}


@pytest.mark.parametrize("dense", [1 << 18, 1])
def test_neighbours_meet_in_blocks_and_not_in_a_join(spark, monkeypatch, dense):
    monkeypatch.setattr(blocks, "LEAST", 60)
    rows, stars = some_ratings(spark)
    if dense == 1:  # the path for wide and thin products
        rows, stars = some_ratings(spark, 400, 300, 500)
    for by, across, m in (("user_id", "item_id", stars), ("item_id", "user_id", stars.T)):
        for metric in ("cosine", "pearson"):
            mean = m.sum(1) / np.maximum((m > 0).sum(1), 1)
            v = np.where(m > 0, m - mean[:, None], 0) if metric == "pearson" else m
            with np.errstate(invalid="ignore", divide="ignore"):
                want = {a: x for a, x in nearest(v, (m > 0).astype(int), 4).items() if x}
            got = recommend.neighbours(rows, by, across, metric, 4)
            assert not re.search(r"Join \[x#", got._jdf.queryExecution().executedPlan().toString())
            got = near_rows(got)
            assert got.keys() == want.keys()
            for a in want:
                assert [b for b, _ in got[a]] == [b for b, _ in want[a]] and [s for _, s in got[a]] == pytest.approx([s for _, s in want[a]], abs=2e-8)
    only = spark.createDataFrame([(3,), (44,), (999,)], "user_id long")
    assert near_rows(recommend.neighbours(rows, only=only)) == {a: x for a, x in near_rows(recommend.neighbours(rows)).items() if a in (3, 44)}
    assert recommend.neighbours(rows.limit(0)).count() == 0


def test_neighbours_of_ids_without_order_meet_in_packed_slices(spark, monkeypatch):
    monkeypatch.setattr(slices, "ENTRIES", 200)
    _, stars = some_ratings(spark)
    rng = np.random.default_rng(9)
    user, item = rng.permutation(stars.shape[0]) * 1000 - 7000, rng.permutation(stars.shape[1]) * 10**12
    cells = [(int(u), int(i), None if (u + i) % 9 == 0 else float(stars[u, i])) for u, i in np.argwhere(stars)]
    plain = spark.createDataFrame([(int(user[u]), int(item[i]), r) for u, i, r in cells], "user_id long, item_id long, stars double")
    named = spark.createDataFrame([(f"u{user[u] + 10**6:09}", f"i{item[i]:015}", r) for u, i, r in cells], "user_id string, item_id string, stars double")
    for metric in ("cosine", "pearson"):
        everyone = plain.select("user_id").distinct()
        want = near_rows(recommend.neighbours(plain, metric=metric, k=5, only=everyone))  # by lists of each item
        got = recommend.neighbours(plain, metric=metric, k=5)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "FlatMapGroupsInArrow" not in plan and "MapInArrow" in plan
        assert near_rows(got) == want and len(want) == len(user)
        assert near_rows(recommend.neighbours(named, metric=metric, k=5)) == {f"u{a + 10**6:09}": [(f"u{b + 10**6:09}", s) for b, s in x] for a, x in want.items()}
    every = near_rows(recommend.neighbours(plain, k=None))
    assert {a: x[:5] for a, x in every.items()} == near_rows(recommend.neighbours(plain, k=5))


def test_scores_of_some_users_and_pairs_are_those_of_all(spark):
    rows, _ = some_ratings(spark)
    some = spark.createDataFrame([(3, 1), (3, 39), (44, 0), (44, 7)], "user_id long, item_id long")
    every = {(r.user_id, r.item_id): r.score for r in recommend.user_scores(rows).where("user_id IN (3, 44)").collect()}
    assert {(r.user_id, r.item_id): r.score for r in recommend.user_scores(rows, only=some).collect()} == pytest.approx(every)
    vectors = recommend.tfidf(spark.createDataFrame([(i, f"a{i % 3}, b{i % 5}, c") for i in range(39)], "item_id long, categories string"))
    profile = recommend.user_profile(rows, vectors, centred=True)
    all_pairs = recommend.content_scores(profile, vectors).join(some, ["user_id", "item_id"])
    got = recommend.content_scores(profile, vectors, some)
    assert {(r.user_id, r.item_id): r.score for r in got.collect()} == pytest.approx({(r.user_id, r.item_id): r.score for r in all_pairs.collect()}) and got.count() == 3


def item_based(stars, k, k_nn):
    """(user, item, score, rank) by brute force."""
    norm = np.sqrt((stars * stars).sum(0))
    norm[norm == 0] = 1e-9
    sim = np.round(stars.T @ stars / np.outer(norm, norm), 8)
    np.fill_diagonal(sim, 0)
    out = []
    for user, row in enumerate(stars):
        rated = np.flatnonzero(row)
        found = []
        for item in np.flatnonzero(row == 0):
            near = sorted(((-sim[i, item], i) for i in rated if sim[i, item] > 0))[:k_nn]
            if near:
                found.append((-round(sum(-s * row[i] for s, i in near) / sum(-s for s, _ in near), 8), item))
        out += [(user, item, -s, rank) for rank, (s, item) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("negative", [False, True])
def test_item_lists_score_in_blocks_and_not_by_joins(spark, monkeypatch, negative):
    monkeypatch.setattr(blocks, "RANGE", 150)
    monkeypatch.setattr(blocks, "SEGMENT", 7)
    _, stars = some_ratings(spark)
    if negative:  # bounds by the rated items don't hold
        stars = np.where(stars == 2, -1.0, stars)
    rows = spark.createDataFrame([(int(u), int(i), float(stars[u, i])) for u, i in np.argwhere(stars)], "user_id long, item_id long, stars double")
    got = recommend.item_topk(rows, 4, 3)
    assert not re.search(r"Join \[(item_id|candidate)#|Window", got._jdf.queryExecution().executedPlan().toString())
    got, want = sorted(got.collect(), key=lambda r: (r.user_id, r.rank)), item_based(stars, 4, 3)
    assert [(r.user_id, r.rank) for r in got] == [(u, rank) for u, _, _, rank in want]
    assert [r.score for r in got] == pytest.approx([s for _, _, s, _ in want], abs=2e-8)
    assert [r.item_id for r in got] == [i for _, i, _, _ in want]
    assert recommend.item_topk(rows.limit(0)).count() == 0


def test_item_based_query_sends_lists_alone(spark):
    plan = registry.QUERIES["rec7_cf_item_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan


@pytest.mark.parametrize("cells", [1 << 20, 64])
def test_content_lists_of_everyone_are_those_of_all_pairs(spark, monkeypatch, cells):
    rows, _ = some_ratings(spark)
    # Many equal texts, one that shares no term, one empty, one null, and two rated items that are no items.
    texts = [(i, f"a{i % 3}, b{i % 4}, c{i % 2}") for i in range(35)] + [(35, "z"), (36, ""), (37, None)] + [(i, f"a{i % 3}, y{i}") for i in range(100, 110)]
    things = spark.createDataFrame(texts, "item_id long, categories string")
    vectors = recommend.tfidf(things)
    want = recommend.ranked(recommend.content_scores(recommend.user_profile(rows, vectors), vectors), "user_id", "score", "item_id", 4)
    monkeypatch.setattr(blocks, "CELLS", cells)
    got = recommend.content_topk(rows, things, 4)
    assert not re.search(r"Join \[term#|Window", got._jdf.queryExecution().executedPlan().toString())
    key = lambda df: sorted((r.user_id, r["rank"], r.item_id, round(r.score, 7)) for r in df.collect())
    assert key(got) == key(want)
    assert recommend.content_topk(rows.limit(0), things).count() == 0
    assert recommend.content_topk(rows, things.limit(0)).count() == 0


def test_content_query_for_everyone_joins_no_terms(spark):
    plan = registry.QUERIES["rec13_content_topk_all_users"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan


def test_hybrid_lists_of_everyone_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "RANGE", 150)
    _, stars = some_ratings(spark, 70, 40, 500)
    stars[60:, :] = 0
    stars[60, :2] = stars[61, 1:3] = 4  # few neighbours
    stars[62, 38] = 5  # none: nobody else has it
    stars[:62, 38] = 0
    rows = spark.createDataFrame([(int(u), int(i), float(stars[u, i])) for u, i in np.argwhere(stars)], "user_id long, item_id long, stars double")
    texts = [(i, f"a{i % 3}, b{i % 4}, c{i % 2}") for i in range(35)] + [(35, "z"), (36, ""), (37, None)] + [(i, f"a{i % 3}, y{i}") for i in range(100, 103)]
    things = spark.createDataFrame(texts, "item_id long, categories string")
    vectors, users = recommend.tfidf(things), rows.select("user_id").distinct()
    content = recommend.content_scores(recommend.user_profile(rows, vectors), vectors)
    key = lambda df: sorted((r.user_id, r["rank"], r.item_id, round(r.score, 7)) for r in df.collect())
    for k in (3, 30):
        want = recommend.unseen_topk(recommend.hybrid_scores(recommend.user_scores(rows, 4), content, users, things, 0.85, 0.15), rows, k)
        assert key(recommend.hybrid_topk(rows, things, k, 4, 0.85, 0.15)) == key(want)
    assert recommend.hybrid_topk(rows.limit(0), things).count() == 0
    assert recommend.hybrid_topk(rows, things.limit(0)).count() == 0


@pytest.mark.parametrize("directed, nodes", [(False, 1), (True, 7)])
def test_pagerank_in_blocks_is_power_iteration(spark, monkeypatch, directed, nodes):
    monkeypatch.setattr(graph, "NODES", nodes)  # 40 blocks of one node come in two parts
    monkeypatch.setattr(graph, "LINKS", 1)
    rng = random.Random(3)
    # Links in both directions, loops and repeats; nodes without links out when directed.
    pairs = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(40):02}") for _ in range(120)] + [("n01", "n39"), ("n39", "n01"), ("n02", "n02")] * 2
    names = sorted({x for p in pairs for x in p})
    a = np.zeros((len(names),) * 2)
    for s, d in pairs:
        a[names.index(s), names.index(d)] = 1
    a = a if directed else np.maximum(a, a.T)
    n, out = len(names), a.sum(1)
    step = np.where(out[:, None] > 0, a / np.maximum(out, 1)[:, None], 1 / n)
    want = np.full(n, 1 / n)
    for _ in range(3):
        want = 0.15 / n + 0.85 * want @ step
    got = {r.node: r.score for r in graph.pagerank(edges(spark, *pairs), directed, max_iter=3, tol=None).collect()}
    assert [got[x] for x in names] == pytest.approx(want, abs=1e-12) and len(got) == n
    assert graph.pagerank(edges(spark, ("n1", "n2")).limit(0)).count() == 0


def test_silhouettes_of_many_labellings_take_one_pass(spark, monkeypatch):
    monkeypatch.setattr(clustering, "TILE", 10)  # blocks of 40 rows
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5)) + 100.0
    x[40:50] = x[30:40]  # equal vectors
    x[50:60] = x[60:70] + 1e-7  # near ones
    labels = np.stack([rng.integers(-1, 3, 90), rng.integers(0, 4, 90), np.r_[5, np.zeros(89)], np.r_[-1, np.zeros(89)], np.zeros(90), np.full(90, -1), np.r_[np.full(89, -1), 2]], 1).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), l.tolist()) for i, (v, l) in enumerate(zip(x, labels))], "id long, v array<double>, labels array<int>")
    want = [clustering.silhouette(df.selectExpr("id", "v", f"labels[{r}] AS label")).first()[0] for r in range(labels.shape[1])]
    passes = []
    monkeypatch.setattr(clustering, "compare_all", lambda *a, f=clustering.compare_all: passes.append(1) or f(*a))
    assert clustering.silhouettes(df, labels.shape[1]) == [w if w is None else pytest.approx(w, abs=1e-9) for w in want]
    rows = clustering.silhouette_by_k(df, [0, 1], {"a": lambda d, k: df.selectExpr("id", f"labels[{k}] AS label")}).collect()
    assert [r.silhouette for r in rows] == pytest.approx(want[:2], abs=1e-9) and [r.best for r in rows] == [w == max(want[:2]) for w in want[:2]]
    assert len(passes) == 2


@pytest.mark.parametrize("name", ["rec4_user_pearson", "rec5_item_cosine"])
def test_similarity_queries_send_packed_slices_alone(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("negative", [False, True])
def test_user_lists_fetch_neighbours_in_packed_slices(spark, monkeypatch, negative):
    monkeypatch.setattr(slices, "ENTRIES", 200)
    _, stars = some_ratings(spark)
    if negative:
        stars = np.where(stars == 2, -1.0, stars)
    stars[:, 5], stars[0, 5], stars[1, :] = 0, 4, 0
    stars[1, 5] = 3  # shares one item with one user
    item = np.random.default_rng(9).permutation(stars.shape[1]) * 10**7 - 50
    rows = spark.createDataFrame([(int(u) * 7 % 997, int(item[i]), float(stars[u, i])) for u, i in np.argwhere(stars)], "user_id long, item_id long, stars double")
    key = lambda df: sorted((r.user_id, r["rank"], r.item_id, round(r.score, 7)) for r in df.collect())
    got = recommend.user_topk(rows, 4, 3)
    assert not re.search(r"Join \[(b|user_id)#|Window", got._jdf.queryExecution().executedPlan().toString())
    assert key(got) == key(recommend.unseen_topk(recommend.user_scores(rows, 3), rows, 4))
    texts = rows.select(rows.user_id.cast("string"), rows.item_id.cast("string"), "stars")
    assert recommend.user_topk(texts, 4, 3).count() == got.count() and recommend.user_topk(rows.limit(0)).count() == 0


def test_hybrid_query_for_everyone_sends_packed_slices_alone(spark):
    rows, _ = some_ratings(spark)
    things = spark.createDataFrame([(i, f"a{i % 3}, b{i % 4}") for i in range(40)], "item_id long, categories string")
    read = []
    slices_topk, slices.hybrid_topk = slices.hybrid_topk, lambda *a: read.append(1) or slices_topk(*a)
    try:
        assert recommend.hybrid_topk(rows, things, 3, 4).count() and read
    finally:
        slices.hybrid_topk = slices_topk
