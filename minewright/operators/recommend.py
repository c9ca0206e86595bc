"""Recommenders over ratings (user_id, item_id, stars) and their metrics.

Scores are rounded before they are ranked and ties go to the smaller id, so
that the order of a sum never decides a rank.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minewright.operators import blocks, slices
from minewright.operators.cleaning import encode_ids
from minewright.operators.eda import split_categories
from minewright.operators.sampling import lot
from minewright.runtime import materialize, ship_package

DIGITS = 8


def ranked(df: DataFrame, group: str, score: str, item: str, k: int) -> DataFrame:
    """The k best rows of each group with rank 1..k."""
    order = Window.partitionBy(group).orderBy(F.desc(score), item)
    return df.withColumn(score, F.round(score, DIGITS)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def random_topk(ratings: DataFrame, users: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """k unseen items for each of a stated set of users, in the order of seeded lots."""
    spine = users.select("user_id").join(ratings.select("item_id").distinct())
    unseen = spine.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy(lot(F.concat_ws("_", "user_id", "item_id"), seed), "item_id")
    return unseen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def popularity_topk(ratings: DataFrame, k: int = 5) -> DataFrame:
    """(user_id, rank, item_id): the items with most ratings that the user hasn't rated.

    The k + (most items of a user) first items are enough for any user; they
    travel as one array, and each user's own among them are subtracted.
    """
    most = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    counts = ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item_id").limit(k + most)
    best = counts.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "item_id"))).alias("s")).select(F.col("s.item_id").alias("best"))
    own = ratings.join(F.broadcast(counts.select("item_id", F.lit(True).alias("listed"))), "item_id", "left")
    own = own.groupBy("user_id").agg(F.collect_list(F.when(F.col("listed"), F.col("item_id"))).alias("seen"))
    left = own.join(F.broadcast(best)).select("user_id", F.posexplode(F.slice(F.array_except("best", "seen"), 1, k)).alias("pos", "item_id"))
    return left.select("user_id", (F.col("pos") + 1).alias("rank"), "item_id")


def popularity_rating(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """pairs with a prediction: the item's mean, or 3."""
    means = ratings.groupBy("item_id").agg(F.avg("stars").alias("mean"))
    return pairs.join(means, "item_id", "left").select("user_id", "item_id", F.coalesce("mean", F.lit(3.0)).alias("prediction"))


def random_rating(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """pairs with a prediction, uniform in 1..5 by their lots."""
    place = F.conv(F.substring(lot(F.concat_ws("_", "user_id", "item_id"), seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return pairs.select("user_id", "item_id", (1 + 4 * place).alias("prediction"))


def neighbours(ratings: DataFrame, by: str = "user_id", across: str = "item_id", metric: str = "cosine", k: int | None = 10, only: DataFrame | None = None) -> DataFrame:
    """(a, b, sim): the k most similar others of each user (or item), or of those in only, with a positive similarity.

    Norms are over all of an entity's ratings; "pearson" centres by its mean.
    Only entities that share a rating meet. Ratings are read twice: give a written table.
    """
    if metric not in ("cosine", "pearson"):
        raise ValueError(f"unknown metric {metric}")
    vectors = ratings.select(F.col(by).alias("e"), F.col(across).alias("x"), F.col("stars").alias("r"))
    if only is None:
        return slices.similar(vectors, k, DIGITS, metric == "pearson")
    if metric == "pearson":
        means = vectors.groupBy("e").agg(F.avg("r").alias("mean"))
        vectors = materialize(vectors.join(means, "e").select("e", "x", (F.col("r") - F.col("mean")).alias("r")), "centred")
    squares = vectors.groupBy("e").agg(F.sum(F.col("r") * F.col("r")).alias("q"))
    return blocks.similar(vectors.join(squares, "e"), k, DIGITS, only.select(F.col(by).alias("e")))


def user_scores(ratings: DataFrame, k_nn: int = 10, metric: str = "cosine", only: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score): weighted means over the neighbours who rated the item; seen items included.

    only: a bounded set of users (user_id) to score, against the neighbours that they have among all.
    """
    near = neighbours(ratings, "user_id", "item_id", metric, k_nn, only)
    if only is not None:
        near = F.broadcast(materialize(near, "near"))
    theirs = near.join(ratings.withColumnRenamed("user_id", "b"), "b")
    return theirs.groupBy(F.col("a").alias("user_id"), "item_id").agg((F.sum(F.col("sim") * F.col("stars")) / F.sum("sim")).alias("score"))


def user_topk(ratings: DataFrame, k: int = 5, k_nn: int = 10) -> DataFrame:
    """(user_id, item_id, score, rank): the k best unrated items of user_scores by cosine for every user; exact.

    Neither pairs of users nor neighbours' ratings are shuffled, where ids are
    whole numbers. Ratings are read more than once: give a written table.
    """
    kinds = {c: ratings.schema[c].dataType.simpleString() for c in ("user_id", "item_id")}
    if not all(slices.whole(ratings, c) for c in kinds):
        return unseen_topk(user_scores(ratings, k_nn), ratings, k)
    out = slices.user_topk(ratings.select(F.col("user_id").alias("e"), F.col("item_id").alias("x"), F.col("stars").alias("r")), k, k_nn, DIGITS)
    return out.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], "score", "rank")


def item_scores(ratings: DataFrame, k_nn: int = 10, metric: str = "cosine") -> DataFrame:
    """(user_id, item_id, score) of unrated items, from the user's k_nn rated items most similar to each."""
    sim = neighbours(ratings, "item_id", "user_id", metric, None)
    near = ratings.join(sim.withColumnRenamed("a", "item_id"), "item_id").select("user_id", F.col("b").alias("candidate"), "item_id", "sim", "stars")
    seen = ratings.select("user_id", F.col("item_id").alias("candidate"))
    near = near.join(seen, ["user_id", "candidate"], "left_anti")
    order = Window.partitionBy("user_id", "candidate").orderBy(F.desc("sim"), "item_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_nn)
    return near.groupBy("user_id", F.col("candidate").alias("item_id")).agg((F.sum(F.col("sim") * F.col("stars")) / F.sum("sim")).alias("score"))


def item_topk(ratings: DataFrame, k: int = 5, k_nn: int = 10) -> DataFrame:
    """(user_id, item_id, score, rank): the k best of item_scores by cosine for every user; exact.

    A task holds the ratings of a range of users and of all who share an item
    with them, and works in memory: neither similar items nor candidates are
    shuffled. Ratings are read more than once: give a written table.
    """
    spark = ratings.sparkSession
    ship_package(spark)
    kinds = {c: ratings.schema[c].dataType.simpleString() for c in ("user_id", "item_id")}
    rows = ratings.where("user_id IS NOT NULL AND item_id IS NOT NULL").select(F.col("user_id").alias("e"), F.col("item_id").alias("x"), F.col("stars").cast("double").alias("r"))
    squares = rows.groupBy("x").agg(F.sum(F.col("r") * F.col("r")).alias("q"))
    rows = materialize(rows.join(squares, "x"), "squared")
    sent, segment = blocks.reach(rows, blocks.share(rows))[0], blocks.SEGMENT

    def listed(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("user_id", "item_id", "score", "rank"), blocks.item_lists(table, k, k_nn, DIGITS, segment))))

    return sent.groupBy("block").applyInArrow(listed, f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, score double, rank int")


def unseen_topk(scores: DataFrame, ratings: DataFrame, k: int = 5) -> DataFrame:
    return ranked(scores.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti"), "user_id", "score", "item_id", k)


def rating_with_fallback(pairs: DataFrame, scores: DataFrame, ratings: DataFrame) -> DataFrame:
    """pairs with a prediction: the score if positive, else the user's mean, the item's mean, or 3."""
    users = ratings.groupBy("user_id").agg(F.avg("stars").alias("user_mean"))
    of_items = ratings.groupBy("item_id").agg(F.avg("stars").alias("item_mean"))
    out = pairs.join(scores, ["user_id", "item_id"], "left").join(users, "user_id", "left").join(of_items, "item_id", "left")
    return out.select("user_id", "item_id", F.coalesce(F.when(F.col("score") > 0, F.col("score")), "user_mean", "item_mean", F.lit(3.0)).alias("prediction"))


def tfidf(items: DataFrame, key: str = "item_id", text: str = "categories") -> DataFrame:
    """(key, term, weight): tf * (ln((1+N)/(1+df)) + 1), each document L2-normalised."""
    terms = items.select(key, F.explode(split_categories(text)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = items.agg(F.count(F.lit(1)).alias("n_docs"))
    raw = terms.join(df, "term").join(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def user_profile(ratings: DataFrame, vectors: DataFrame, centred: bool = False) -> DataFrame:
    """(user_id, term, weight): the mean of the rated items' vectors; centred: the sum of (stars - 3) * vector, L2-normalised."""
    sizes = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    joined = ratings.join(vectors, "item_id")
    if not centred:
        return joined.groupBy("user_id", "term").agg(F.sum("weight").alias("w")).join(sizes, "user_id").select("user_id", "term", (F.col("w") / F.col("n")).alias("weight"))
    raw = joined.groupBy("user_id", "term").agg(F.sum((F.col("stars") - 3) * F.col("weight")).alias("w"))
    norm = raw.groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "user_id").select("user_id", "term", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("weight"))


def content_scores(profile: DataFrame, vectors: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score): cosine of each profile with the items that share a term with it; of the pairs alone, a bounded set, if given."""
    norm = profile.groupBy("user_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    met = vectors.withColumnRenamed("weight", "v")
    met = profile.join(met, "term") if pairs is None else met.join(F.broadcast(pairs.select("user_id", "item_id").distinct()), "item_id").join(profile, ["user_id", "term"])
    dot = met.groupBy("user_id", "item_id").agg(F.sum(F.col("weight") * F.col("v")).alias("dot"))
    return dot.join(norm, "user_id").where("norm > 0").select("user_id", "item_id", (F.col("dot") / F.col("norm")).alias("score"))


def item_classes(items: DataFrame, vectors: DataFrame, k: int, key: str = "item_id", text: str = "categories") -> tuple[DataFrame, DataFrame]:
    """(classes (g, ids[], t[], w[]), members (item_id, g)): each different text once, named by its first item, with its k first items and its vector in numbered terms.

    vectors are those of tfidf, which gives equal texts equal vectors; give a written table.
    """
    texts = items.select(F.col(key).alias("item_id"), F.col(text).alias("c")).where("item_id IS NOT NULL AND c IS NOT NULL").distinct()
    heads = texts.groupBy("c").agg(F.min("item_id").alias("g"))
    members = materialize(texts.join(heads, "c").select("item_id", "g"), "members")
    first = Window.partitionBy("g").orderBy("item_id")
    listed = members.withColumn("p", F.row_number().over(first)).where(F.col("p") <= k).groupBy("g").agg(F.collect_list("item_id").alias("ids"))
    own = vectors.join(members.where("item_id = g").select(F.col("g").alias(key)), key, "left_semi").join(encode_ids(vectors, "term", "t"), "term")
    own = own.groupBy(F.col(key).alias("g")).agg(F.collect_list(F.struct(F.col("t").cast("int").alias("t"), "weight")).alias("v"))
    return materialize(listed.join(own, "g").select("g", "ids", F.col("v.t").alias("t"), F.col("v.weight").alias("w")), "classes"), members


def content_topk(ratings: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """(user_id, item_id, score, rank): the k items nearest to the mean of the vectors of a user's items, rated ones included, for every user; exact.

    Items of equal text are scored once. A task multiplies a block of users by
    all different texts, which each block gets.
    """
    spark = ratings.sparkSession
    ship_package(spark)
    kinds = {c: ratings.schema[c].dataType.simpleString() for c in ("user_id", "item_id")}
    classes, members = item_classes(items, materialize(tfidf(items), "item-vectors"), k)
    known = members.join(classes.select("g"), "g", "left_semi")
    own = ratings.select("user_id", "item_id").join(known, "item_id", "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("g").alias("g"))
    own = materialize(own.where(F.size("g") > 0), "own")
    parts, cells = max(blocks.BLOCKS, own.count() // blocks.USERS), blocks.CELLS
    users = own.withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int"))
    sent = classes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def listed(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("user_id", "item_id", "score", "rank"), blocks.content_lists(left, right, k, DIGITS, cells))))

    return users.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(listed, f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, score double, rank int")


def hybrid_scores(cf: DataFrame, content: DataFrame, users: DataFrame, items: DataFrame, cf_weight: float = 0.5, content_weight: float = 0.5) -> DataFrame:
    """(user_id, item_id, score) over all items, for a stated set of users.

    CF scores are min-max scaled per user over the positive ones (others count
    0), content cosines are mapped to 0..1.
    """
    ids = F.broadcast(users.select("user_id").distinct())
    own = cf.join(ids, "user_id", "left_semi").where("score > 0")
    ends = own.groupBy("user_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    own = own.join(ends, "user_id").select("user_id", "item_id", ((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)).alias("c"))
    spine = items.select("item_id").distinct().join(ids)
    both = spine.join(own, ["user_id", "item_id"], "left").join(content.withColumnRenamed("score", "t"), ["user_id", "item_id"], "left")
    score = cf_weight * F.coalesce("c", F.lit(0.0)) + content_weight * (F.coalesce("t", F.lit(0.0)) + 1) / 2
    return both.select("user_id", "item_id", score.alias("score"))


def hybrid_lists(ratings: DataFrame, marks: DataFrame, classes: DataFrame, k: int, k_nn: int, cf_weight: float, content_weight: float) -> DataFrame:
    """What slices.hybrid_topk gives, for ids of any kind, from the lists of all who share an item, sent to each range of users."""
    kinds = {c: ratings.schema[c].dataType.simpleString() for c in ("user_id", "item_id")}
    rows = ratings.where("user_id IS NOT NULL AND item_id IS NOT NULL").join(marks, "item_id", "left")
    rows = materialize(rows.select(F.col("user_id").alias("e"), F.col("item_id").alias("x"), F.col("stars").cast("double").alias("r"), F.coalesce("mark", F.lit(-2)).cast("long").alias("q")), "marked")
    sent, parts = blocks.reach(rows, blocks.share(rows))
    texts = materialize(classes.select("number", "t", "w"), "texts").join(F.broadcast(parts))

    def listed(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("user_id", "item_id", "score", "rank"), blocks.hybrid_lists(left, right, k, k_nn, cf_weight, content_weight, DIGITS))))

    return sent.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(listed, f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, score double, rank int")


def hybrid_topk(ratings: DataFrame, items: DataFrame, k: int = 5, k_nn: int = 10, cf_weight: float = 0.5, content_weight: float = 0.5) -> DataFrame:
    """(user_id, item_id, score, rank): the k best unrated items of hybrid_scores by user_scores and content_scores, for every user; exact.

    Scores items that a user's neighbours rated, in ranges of users, and all
    items for those users alone whose list these can't settle. Weights are 0 or
    more. Ratings are read more than once: give a written table.
    """
    spark = ratings.sparkSession
    ship_package(spark)
    kinds = {c: ratings.schema[c].dataType.simpleString() for c in ("user_id", "item_id")}
    vectors = materialize(tfidf(items), "item-vectors")
    classes, members = item_classes(items, vectors, k)
    classes = classes.join(encode_ids(classes, "g", "number"), "g")
    marks = items.select("item_id").distinct().join(members.join(classes.select("g", "number"), "g"), "item_id", "left").select("item_id", F.coalesce("number", F.lit(-1)).cast("long").alias("mark"))
    if all(slices.whole(ratings, c) for c in kinds) and slices.whole(items, "item_id"):
        rows = ratings.select(F.col("user_id").alias("e"), F.col("item_id").alias("x"), F.col("stars").alias("r"))
        marks = marks.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("x"), "mark")
        texts = classes.select(F.col("number").cast("long").alias("number"), "t", "w")
        out = slices.hybrid_topk(rows, marks, texts, k, k_nn, cf_weight, content_weight, DIGITS)
        out = out.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], "score", "rank")
    else:
        out = hybrid_lists(ratings, marks, classes, k, k_nn, cf_weight, content_weight)
    out = materialize(out, "hybrid")
    open_ = out.where("rank = 0").select("user_id")
    out = out.where("rank > 0")
    if open_.isEmpty():
        return out
    own = user_profile(ratings, vectors).join(F.broadcast(open_), "user_id", "left_semi")
    rest = hybrid_scores(user_scores(ratings, k_nn, only=open_), content_scores(own, vectors), open_, items, cf_weight, content_weight)
    return out.unionByName(unseen_topk(rest, ratings, k))


def content_rating(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """pairs with a prediction 1..5: 3 + 2 cos, 3 where the profile and the item share nothing."""
    both = pairs.join(content, ["user_id", "item_id"], "left")
    return both.select("user_id", "item_id", F.greatest(F.lit(1.0), F.least(F.lit(5.0), 3 + 2 * F.coalesce("score", F.lit(0.0)))).alias("prediction"))


def hybrid_rating(pairs: DataFrame, cf: DataFrame, content: DataFrame, cf_weight: float = 0.5, content_weight: float = 0.5) -> DataFrame:
    """pairs with a prediction 1..5: weighted where CF has a positive score, the content rating otherwise."""
    both = content_rating(pairs, content).withColumnRenamed("prediction", "text").join(cf.withColumnRenamed("score", "c"), ["user_id", "item_id"], "left")
    mixed = F.when(F.col("c") > 0, cf_weight * F.col("c") + content_weight * F.col("text")).otherwise(F.col("text"))
    return both.select("user_id", "item_id", F.greatest(F.lit(1.0), F.least(F.lit(5.0), mixed)).alias("prediction"))


def holdout(ratings: DataFrame, users: int = 100, least_items: int = 4, least_ratings: int = 5, positive: float = 3.5, share: float = 0.3, seed: int = 42) -> DataFrame:
    """(user_id, item_id, stars) hidden from each of the first `users` users: max(1, share) of two positives or more."""
    active = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_items).orderBy("user_id").limit(users)
    known = ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_ratings)
    good = ratings.where(F.col("stars") >= positive).join(F.broadcast(active.select("user_id")), "user_id", "left_semi").join(known.select("item_id"), "item_id", "left_semi")
    mine = Window.partitionBy("user_id")
    order = mine.orderBy(lot(F.concat_ws("_", "user_id", "item_id"), seed), "item_id")
    good = good.withColumn("size", F.count(F.lit(1)).over(mine)).withColumn("place", F.row_number().over(order))
    return good.where("size >= 2").where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("size") * share))).select("user_id", "item_id", "stars")


def rank_metrics(actual: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    """Per user of actual: precision@k (over k), recall@k and NDCG@k (binary gains) of predicted (user_id, item_id, rank)."""
    sizes = actual.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    hits = actual.select("user_id", "item_id").join(predicted.where(F.col("rank") <= k), ["user_id", "item_id"])
    got = hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("size").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    hit = F.coalesce(F.col("hits"), F.lit(0))
    return sizes.join(got, "user_id", "left").select(
        "user_id", (hit / F.lit(float(k))).alias("precision"), (hit / F.col("size")).alias("recall"), (F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg")
    )


def errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(rmse, mae), 0 when empty."""
    gap = F.col(actual) - F.col(predicted)
    return df.agg(F.coalesce(F.sqrt(F.avg(gap * gap)), F.lit(0.0)).alias("rmse"), F.coalesce(F.avg(F.abs(gap)), F.lit(0.0)).alias("mae"))


def novelty(predicted: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per user: the mean of -log2(share of users who rated the item); unrated items count 0."""
    users = ratings.agg(F.countDistinct("user_id").alias("users"))
    counts = ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    own = predicted.join(counts, "item_id", "left").join(F.broadcast(users))
    return own.groupBy("user_id").agg(F.avg(F.coalesce(-F.log2(F.col("n") / F.col("users")), F.lit(0.0))).alias("novelty"))


def diversity(predicted: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per user: the mean of 1 - cosine over pairs of listed items; 0 with fewer than two.

    The vectors are unit, so the sum of all pairs' cosines follows from the
    length of their sum: (|sum|^2 - n) / 2, without pairing items.
    """
    sizes = predicted.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    joined = predicted.select("user_id", "item_id").join(vectors, "item_id")
    own = joined.groupBy("user_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("units"))
    total = joined.groupBy("user_id", "term").agg(F.sum("weight").alias("w")).groupBy("user_id").agg(F.sum(F.col("w") * F.col("w")).alias("square"))
    out = sizes.join(own, "user_id", "left").join(total, "user_id", "left").na.fill(0.0, ["units", "square"])
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return out.select("user_id", F.when(F.col("n") < 2, 0.0).otherwise(1 - (F.col("square") - F.col("units")) / 2 / pairs).alias("diversity"))


def errors_by_user(actual: DataFrame, guessed: DataFrame) -> DataFrame:
    """(user_id, rmse, mae) of guessed (user_id, item_id, prediction) against actual (user_id, item_id, stars)."""
    gap = F.col("stars") - F.col("prediction")
    return actual.join(guessed, ["user_id", "item_id"]).groupBy("user_id").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))


MEASURES = ["precision", "recall", "ndcg", "rmse", "mae", "novelty", "diversity"]


def evaluate(hidden: DataFrame, ratings: DataFrame, items: DataFrame, k: int = 30, k_nn: int = 20, cf_weight: float = 0.85, content_weight: float = 0.15, seed: int = 42) -> DataFrame:
    """(model, users, and each of MEASURES): means over the users of hidden for hybrid, popularity and random lists.

    Models learn from ratings without hidden, which must be a bounded set of
    users (the hybrid and random models score all items for each); novelty
    counts all ratings. Errors are taken per user first.
    """
    vectors = materialize(tfidf(items), "eval-vectors")
    hidden = materialize(hidden.select("user_id", "item_id", "stars"), "eval-hidden")
    pairs, users = hidden.select("user_id", "item_id"), hidden.select("user_id").distinct()
    train = materialize(ratings.join(pairs, ["user_id", "item_id"], "left_anti"), "eval-train")
    own = lambda df: df.join(F.broadcast(users), "user_id", "left_semi")
    cf = materialize(user_scores(train, k_nn, only=users), "eval-cf")
    content = materialize(content_scores(user_profile(own(train), vectors, centred=True), vectors), "eval-content")
    models = {
        "hybrid": (unseen_topk(hybrid_scores(cf, content, users, items, cf_weight, content_weight), train, k), hybrid_rating(pairs, cf, content, cf_weight, content_weight)),
        "popularity": (own(popularity_topk(train, k)), popularity_rating(pairs, train)),
        "random": (random_topk(train, users, k, seed), random_rating(pairs, seed)),
    }
    out = None
    for model, (lists, guessed) in models.items():
        lists = materialize(lists.select("user_id", "item_id", "rank"), "eval-lists")
        each = rank_metrics(hidden, lists, k).join(errors_by_user(hidden, guessed), "user_id", "left")
        each = each.join(novelty(lists, ratings), "user_id", "left").join(diversity(lists, vectors), "user_id", "left")
        row = each.na.fill(0.0, MEASURES).agg(F.count(F.lit(1)).alias("users"), *[F.avg(m).alias(m) for m in MEASURES]).select(F.lit(model).alias("model"), "*")
        out = row if out is None else out.union(row)
    return out
