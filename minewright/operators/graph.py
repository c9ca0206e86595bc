"""Bipartite graph analytics over an edge table (src, dst) of prefixed node names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minewright.operators.cleaning import encode_ids
from minewright.runtime import discard, materialize, ship_package


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def graph_metrics(edges: DataFrame) -> DataFrame:
    """Counts, density (2E / V(V-1)) and bipartite density (E / UP) of a bipartite graph."""
    sides = nodes_of(edges).agg(F.count_if(F.col("node").startswith("U_")).alias("users"), F.count_if(~F.col("node").startswith("U_")).alias("items"))
    n = edges.agg(F.count(F.lit(1)).alias("edges"))
    v = (F.col("users") + F.col("items")).cast("double")
    e = F.col("edges").cast("double")
    return sides.join(F.broadcast(n)).select(
        "users",
        "items",
        "edges",
        F.when(v > 1, 2 * e / (v * (v - 1))).otherwise(0.0).alias("density"),
        F.when((F.col("users") > 0) & (F.col("items") > 0), e / (F.col("users") * F.col("items"))).otherwise(0.0).alias("bipartite_density"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def bfs_levels(edges: DataFrame, sources: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(source, node, distance) of all nodes that each source reaches; all sources advance together."""
    links = materialize(both_ways(edges), "bfs-links")
    seen = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("distance")), "bfs")
    front, parts = seen, [seen]
    for depth in range(1, max_depth + 1):
        step = front.select("source", F.col("node").alias("src")).join(links, "src").select("source", F.col("dst").alias("node")).distinct()
        # Neighbours of a level lie on it, the one before or the next.
        for old in parts[-2:]:
            step = step.join(old.select("source", "node"), ["source", "node"], "left_anti")
        front = materialize(step.withColumn("distance", F.lit(depth)), "bfs")
        if front.isEmpty():
            break
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def diameter(edges: DataFrame, nodes: DataFrame | None = None, method: str = "auto", sweeps: int = 10, exact_limit: int = 1000, seed: int = 42) -> int:
    """The greatest distance: exact from all nodes, or a lower bound from seeded double sweeps."""
    if method not in ("auto", "exact", "approximate"):
        raise ValueError(f"unknown method {method}")
    nodes = nodes if nodes is not None else nodes_of(edges)
    if method == "auto":
        method = "exact" if nodes.limit(exact_limit + 1).count() <= exact_limit else "approximate"
    far = lambda df: df.groupBy("source").agg(F.max(F.struct("distance", "node")).alias("far"))
    if method == "exact":
        return int(bfs_levels(edges, nodes).agg(F.max("distance")).first()[0] or 0)
    start = nodes.orderBy(F.md5(F.concat_ws("_", F.lit(str(seed)), "node")), "node").limit(sweeps)
    ends = materialize(far(bfs_levels(edges, start)).select("far.node").distinct(), "bfs-ends")
    return int(bfs_levels(edges, ends).agg(F.max("distance")).first()[0] or 0)


#: Nodes of a block and links of a row at most.
NODES, LINKS = 1 << 18, 1 << 18


def pagerank(edges: DataFrame, directed: bool = False, damping: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """(node, score). Starts at 1/N; dangling mass is spread evenly; stops once the L1 change is below tol.

    With tol None exactly max_iter rounds run. Nodes are numbered and cut into
    blocks once, and links written once as arrays of places in a source and a
    target block. A round sends the scores, a row a block, to the links and
    adds up in memory what each target block gets; links aren't shuffled, and
    only two scalars come to the driver besides the broadcast scores, in parts
    of 32 blocks.
    """
    spark = edges.sparkSession
    ship_package(spark)
    pairs = materialize(edges.select("src", "dst").distinct(), "pr-pairs")
    names = materialize(encode_ids(nodes_of(pairs), "node"), "pr-names")
    n, size = names.count(), NODES
    if n == 0:
        return names.select("node", F.lit(0.0).alias("score"))
    ids = lambda c: names.select(F.col("node").alias(c), F.col("index").alias(c[0]))
    links = pairs.join(ids("src"), "src").join(ids("dst"), "dst").select("s", "d")
    if not directed:
        one_way = pairs.select("src").distinct().join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").isEmpty()
        links = links.select(F.explode(F.array(F.struct("s", "d"), F.struct(F.col("d").alias("s"), F.col("s").alias("d")))).alias("l")).select("l.*")
        links = links if one_way else links.distinct()
    links = materialize(links, "pr-links")
    whole = links.count()
    blocks = -(-n // size)
    chunks = max(1, -(-whole // (LINKS * blocks * blocks)))
    place = lambda c: (F.col(c) % size).cast("int")
    cut = links.select(F.floor(F.col("s") / size).cast("int").alias("sb"), F.floor(F.col("d") / size).cast("int").alias("db"), F.pmod(F.xxhash64("s", "d"), F.lit(chunks)).alias("chunk"), place("s").alias("s"), place("d").alias("d"))

    def packed(table: pa.Table) -> pa.Table:
        s, d = table["s"].to_numpy(), table["d"].to_numpy()
        by = np.argsort(d, kind="stable")
        head = {c: table[c][:1].cast(pa.int32()) for c in ("sb", "db")}
        return pa.table(head | {"s": pa.array([s[by].astype(np.int32).tobytes()], pa.binary()), "d": pa.array([d[by].astype(np.int32).tobytes()], pa.binary())})

    cells = cut.groupBy("db", "sb", "chunk").applyInArrow(packed, "sb int, db int, s binary, d binary")
    cells = materialize(cells.repartitionByRange(max(1, min(whole // (LINKS * 4), 4096)), "db", "sb").sortWithinPartitions("db", "sb"), "pr-cells")
    outs = links.groupBy("s").agg(F.count(F.lit(1)).alias("out"))
    counted = spark.range(n).join(outs, F.col("id") == F.col("s"), "left").select(F.floor(F.col("id") / size).cast("int").alias("db"), place("id").alias("p"), F.coalesce("out", F.lit(0)).alias("out"))

    def begun(table: pa.Table) -> pa.Table:
        out = np.zeros(len(table))
        out[table["p"].to_numpy()] = table["out"].to_numpy()
        score = np.full(len(out), 1.0 / n)
        sent = np.divide(score, out, out=np.zeros(len(out)), where=out > 0)
        return state(table["db"][0].as_py(), score, sent, out, np.inf)

    def state(block: int, score: np.ndarray, sent: np.ndarray, out: np.ndarray, change: float) -> pa.Table:
        return pa.table({"db": pa.array([block], pa.int32()), "score": [score.tobytes()], "sent": [sent.tobytes()], "outs": [out.tobytes()], "loose": [float(score[out == 0].sum())], "change": [float(change)]})

    kind = "db int, score binary, sent binary, outs binary, loose double, change double"
    now = materialize(counted.groupBy("db").applyInArrow(begun, kind), "pr")
    discard(links)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, got = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"db": pa.array([at], pa.int32()), "got": pa.array([got.tobytes()], pa.binary())})

        for batch in batches:
            for i in range(batch.num_rows):
                db = batch["db"][i].as_py()
                if db != at:
                    if at is not None:
                        yield row()
                    at, got = db, np.zeros(min(size, n - db * size))
                s, d, sent = (np.frombuffer(batch[c][i].as_buffer(), t) for c, t in (("s", np.int32), ("d", np.int32), ("sent", np.float64)))
                part = np.bincount(d, sent[s])
                got[: len(part)] += part
        if at is not None:
            yield row()

    loose = now.agg(F.sum("loose")).first()[0]
    for _ in range(max_iter):
        base = (1 - damping) / n + damping * loose / n

        def moved(left: pa.Table, right: pa.Table) -> pa.Table:
            score, out = (np.frombuffer(left[c][0].as_buffer()) for c in ("score", "outs"))
            got = np.zeros(len(score))
            for i in range(len(right)):
                got += np.frombuffer(right["got"][i].as_buffer())
            then = base + damping * got
            sent = np.divide(then, out, out=np.zeros(len(out)), where=out > 0)
            return state(left["db"][0].as_py(), then, sent, out, np.abs(then - score).sum())

        gotten = None
        for lo in range(0, blocks, 32):
            some = F.broadcast(now.where(F.col("db").between(lo, lo + 31)).select(F.col("db").alias("sb"), "sent"))
            part = cells.where(F.col("sb").between(lo, lo + 31)).join(some, "sb").select("db", "s", "d", "sent").mapInArrow(gather, "db int, got binary")
            gotten = part if gotten is None else gotten.union(part)
        then = materialize(now.groupBy("db").cogroup(gotten.groupBy("db")).applyInArrow(moved, kind), "pr")
        loose, change = then.agg(F.sum("loose"), F.sum("change")).first()
        discard(now)
        now = then
        if tol is not None and change < tol:
            break

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                score = np.frombuffer(batch["score"][i].as_buffer())
                yield pa.RecordBatch.from_pydict({"index": np.arange(len(score)) + batch["db"][i].as_py() * size, "score": score})

    return now.select("db", "score").mapInArrow(listed, "index long, score double").join(names, "index").select("node", "score")


def hits(edges: DataFrame, directed: bool = False, max_iter: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """(node, hub, authority): both updated at once from the last round's values, then L2-normalised."""
    links = materialize(edges.select("src", "dst").distinct() if directed else both_ways(edges), "hits-links")
    now = materialize(nodes_of(edges).select("node", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")), "hits")
    for _ in range(max_iter):
        up = links.join(now.select(F.col("node").alias("src"), "hub"), "src").select(F.col("dst").alias("node"), F.col("hub").alias("a"), F.lit(0.0).alias("h"))
        down = links.join(now.select(F.col("node").alias("dst"), "authority"), "dst").select(F.col("src").alias("node"), F.lit(0.0).alias("a"), F.col("authority").alias("h"))
        sums = up.union(down).groupBy("node").agg(F.sum("a").alias("a"), F.sum("h").alias("h"))
        raw = materialize(now.join(sums, "node", "left").na.fill(0.0, ["a", "h"]), "hits-raw")
        na, nh = raw.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))), F.sqrt(F.sum(F.col("h") * F.col("h")))).first()
        a, h = F.col("a") / (na or 1.0), F.col("h") / (nh or 1.0)
        change = raw.agg(F.sum(F.abs(a - F.col("authority"))), F.sum(F.abs(h - F.col("hub")))).first() if tol is not None else None
        discard(now)
        now = materialize(raw.select("node", h.alias("hub"), a.alias("authority")), "hits")
        discard(raw)
        if change is not None and (change[0] or 0) < tol and (change[1] or 0) < tol:
            break
    return now


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """The edges left when nodes of degree below k on either side have been removed until none is left."""
    now = materialize(edges.select("src", "dst").distinct(), "core")
    size = now.count()
    while size:
        users = now.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("src")
        items = now.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("dst")
        then = materialize(now.join(users, "src", "left_semi").join(items, "dst", "left_semi").select("src", "dst"), "core")
        left = then.count()
        discard(now)
        now = then
        if left == size:
            break
        size = left
    return now


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(modularity) of a partition (node, community): the sum of in/2m - (tot/2m)^2."""
    links = both_ways(edges).join(partition.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src")
    links = links.join(partition.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    per = links.groupBy("cs").agg(F.count(F.lit(1)).cast("double").alias("tot"), F.count_if(F.col("cs") == F.col("cd")).cast("double").alias("inside"))
    whole = per.agg(F.sum("tot").alias("m2"))
    share = F.col("tot") / F.col("m2")
    return per.join(F.broadcast(whole)).agg(F.sum(F.col("inside") / F.col("m2") - share * share).alias("modularity"))


def community_profile(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Per community: users, items, internal and crossing edges, internal / (users * items)."""
    a = partition.select(F.col("node").alias("src"), F.col("community").alias("cs"))
    b = partition.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
    ends = edges.select("src", "dst").join(a, "src").join(b, "dst")
    end = lambda c, i, x: F.struct(F.col(c).alias("community"), F.lit(i).alias("i"), F.lit(x).alias("c"))
    inside = F.when(F.col("cs") == F.col("cd"), F.array(end("cs", 1, 0))).otherwise(F.array(end("cs", 0, 1), end("cd", 0, 1)))
    ends = ends.select(F.explode(inside).alias("x"))
    counted = ends.select("x.*").groupBy("community").agg(F.sum("i").alias("internal"), F.sum("c").alias("crossing"))
    sides = partition.groupBy("community").agg(F.count_if(F.col("node").startswith("U_")).alias("users"), F.count_if(~F.col("node").startswith("U_")).alias("items"))
    out = sides.join(counted, "community", "left").na.fill(0, ["internal", "crossing"])
    cells = F.col("users") * F.col("items")
    return out.withColumn("density", F.when(cells > 0, F.col("internal") / cells).otherwise(0.0))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def community_subgraph(edges: DataFrame, partition: DataFrame, communities: int = 5, per_community: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): the best-connected nodes of the largest communities and the edges among them."""
    top = partition.groupBy("community").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "community").limit(communities)
    ranked = partition.join(F.broadcast(top.select("community")), "community").join(degrees(edges), "node")
    nodes = top_per_group(ranked, ["community"], [F.desc("degree"), F.col("node")], per_community)
    ids = F.broadcast(nodes.select("node"))
    links = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, links


def compare_rankings(a: DataFrame, b: DataFrame, k: int = 50, digits: int = 10) -> DataFrame:
    """(n, spearman, overlap) of two score tables (node, score); ordinal ranks, ties by node; overlap divides by k."""
    ranks = lambda df, name: df.select("node", F.row_number().over(Window.orderBy(F.desc(F.round("score", digits)), "node")).alias(name))
    both = ranks(a, "ra").join(ranks(b, "rb"), "node", "full")
    n = both.agg(F.count(F.lit(1)).alias("n"))
    both = both.join(F.broadcast(n))
    half = F.col("n") / 2.0
    d = F.coalesce(F.col("ra").cast("double"), half) - F.coalesce(F.col("rb").cast("double"), half)
    whole = F.max("n").cast("double")
    return both.agg(
        F.max("n").alias("n"),
        F.when(F.max("n") > 1, 1 - 6 * F.sum(d * d) / (whole * (whole * whole - 1))).otherwise(0.0).alias("spearman"),
        (F.count_if((F.col("ra") <= k) & (F.col("rb") <= k)) / F.lit(float(k))).alias("overlap"),
    )


def louvain(edges: DataFrame, max_levels: int = 10, tol: float = 1e-6, rounds: int = 20) -> tuple[DataFrame, float]:
    """(partition (node, community), modularity) by synchronous local moving and condensation.

    All nodes choose their best community from the same state; a round admits
    only moves to lower (even rounds) or higher (odd rounds) community names,
    so that two nodes can't swap. A round that lowers modularity is undone, and
    later ones admit half as many of the moves, drawn by node; a level ends when
    no move gains anything, or after `rounds`. The result is seeded by nothing but the node names.
    """
    weights = materialize(both_ways(edges).select("src", "dst", F.lit(1.0).alias("w")), "lv")
    m2 = weights.agg(F.sum("w")).first()[0] or 0.0
    whole = materialize(nodes_of(edges).select("node", F.col("node").alias("community")), "lv")
    if not m2:
        return whole, 0.0

    def quality(links: DataFrame, part: DataFrame) -> float:
        ends = links.join(part.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(part.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
        per = ends.groupBy("cs").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside"))
        return float(per.agg(F.sum(F.col("inside") / m2 - F.col("tot") * F.col("tot") / (m2 * m2))).first()[0])

    best = quality(weights, whole)
    for _ in range(max_levels):
        part = materialize(weights.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "lv")
        strength = materialize(weights.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "lv")
        q, idle, share = quality(weights, part), 0, 1.0
        for i in range(rounds):
            tot = part.join(strength, "node").groupBy("community").agg(F.sum("k").alias("tot"))
            to = weights.where("src <> dst").join(part.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("kin"))
            own = part.withColumnRenamed("community", "old").join(strength, "node")
            own = own.join(to.withColumnRenamed("community", "old").withColumnRenamed("kin", "kold"), ["node", "old"], "left").na.fill(0.0, ["kold"])
            own = own.join(tot.withColumnRenamed("community", "old").withColumnRenamed("tot", "told"), "old")
            gain = (F.col("kin") - F.col("kold")) * 2 / m2 - F.col("k") * (F.col("tot") - F.col("told") + F.col("k")) * 2 / (m2 * m2)
            side = F.col("community") < F.col("old") if i % 2 == 0 else F.col("community") > F.col("old")
            moves = own.join(to, "node").join(tot, "community").where(side).select("node", "community", F.round(gain, 12).alias("gain")).where(F.col("gain") > tol)
            moves = moves.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("g"), "community")).alias("m")).select("node", F.col("m.community").alias("next"))
            moves = materialize(moves, "lv")
            if not moves.limit(1).count():
                idle += 1
                if idle == 2:
                    break
                continue
            idle = 0
            drawn = moves.where(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1 << 20)) < int(share * (1 << 20)))
            then = materialize(part.join(drawn, "node", "left").select("node", F.coalesce("next", "community").alias("community")), "lv")
            after = quality(weights, then)
            if after > q:
                part, q = then, after
            elif drawn.limit(1).count():
                share = max(share / 2, 1 / 1024)
        if q <= best + tol:
            break
        best = q
        whole = materialize(whole.withColumnRenamed("community", "inner").join(part.withColumnRenamed("node", "inner"), "inner").select("node", "community"), "lv")
        ends = weights.join(part.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(part.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
        weights = materialize(ends.groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w")), "lv")
    return whole, best


def giant_component(components: DataFrame) -> DataFrame:
    """(size, share): the nodes of the largest component of (node, component), and their percentage of all."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("size"), (100.0 * F.max("n") / F.sum("n")).alias("share"))


def top_nodes(scores: DataFrame, names: DataFrame, k: int = 10, default: str = "unknown") -> DataFrame:
    """(node, score, name) of the k highest scores (node, score), ties by node; nodes that names (node, name) lacks are `default`."""
    top = scores.orderBy(F.desc("score"), "node").limit(k)
    return top.join(names, "node", "left").select("node", "score", F.coalesce("name", F.lit(default)).alias("name"))
