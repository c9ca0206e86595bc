"""Clustering by summaries (count, sum, sum of squares per dimension) with diagonal Mahalanobis distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.operators.clustering import kmeans, seed_centres
from minewright.operators.sampling import hash_sample
from minewright.operators.vectors import distances, stack
from minewright.runtime import materialize, ship_package

LEAST_VARIANCE = 1e-6


def summaries(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, i, n, s, q): the count, sum and sum of squares of each dimension of points (id, v) in each cluster of (id, label)."""
    long = points.select("id", "v").join(labels.select("id", "label"), "id").select("label", F.posexplode("v").alias("i", "x"))
    return long.groupBy("label", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))


def mahalanobis(points: DataFrame, sums: DataFrame) -> DataFrame:
    """(id, label, distance) of each point to each summary; infinite to a cluster of one. The summaries are of size k * d."""
    mean = F.col("s") / F.col("n")
    variance = F.col("q") / F.col("n") - mean * mean
    moments = F.broadcast(sums.select("label", "i", "n", mean.alias("m"), F.when(variance <= 0, LEAST_VARIANCE).otherwise(variance).alias("var")))
    long = points.select("id", F.posexplode("v").alias("i", "x")).join(moments, "i")
    gap = F.col("x") - F.col("m")
    far = F.when(F.max("n") <= 1, float("inf")).otherwise(F.sqrt(F.sum(gap * gap / F.col("var"))))
    return long.groupBy("id", "label").agg(far.alias("distance"))


class Summary:
    """Clusters as matrices: n (k), s and q (k, d)."""

    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray):
        self.n, self.s, self.q = n, s, q

    @classmethod
    def of(cls, x: np.ndarray, member: np.ndarray, k: int) -> Summary:
        one = (member[:, None] == np.arange(k)).astype(float)
        return cls(one.sum(0), one.T @ x, one.T @ (x * x))

    def pick(self, which: np.ndarray) -> Summary:
        return Summary(self.n[which], self.s[which], self.q[which])

    def __add__(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, self.s + other.s, self.q + other.q)

    def beside(self, other: Summary) -> Summary:
        return Summary(*(np.concatenate([a, b]) for a, b in ((self.n, other.n), (self.s, other.s), (self.q, other.q))))

    def grouped(self, into: np.ndarray, k: int) -> Summary:
        one = (into[:, None] == np.arange(k)).astype(float)
        return Summary(one.T @ self.n, one.T @ self.s, one.T @ self.q)

    def means(self) -> np.ndarray:
        return self.s / np.maximum(self.n, 1)[:, None]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """(rows of x, clusters); infinite to a cluster of one or none."""
        means = self.means()
        variance = self.q / np.maximum(self.n, 1)[:, None] - means * means
        weight = 1 / np.where(variance <= 0, LEAST_VARIANCE, variance)
        out = np.stack([np.sqrt(((x - m) ** 2 * w).sum(1)) for m, w in zip(means, weight)], 1)
        out[:, self.n <= 1] = np.inf
        return out


def _settled(df: DataFrame, held: Summary, threshold: float) -> DataFrame:
    """df (id, v) with label, the nearest summary under the threshold, else -1."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = held.distances(stack(batch["v"]))
                near = d.argmin(1)
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "label": np.where(d[np.arange(len(d)), near] < threshold, near, -1)})

    return df.select("id", "v").mapInPandas(assign, "id long, v array<double>, label long")


def _summary(df: DataFrame, k: int, d: int) -> Summary:
    """The summary of (id, v, label) for the labels 0..k-1, added up on the executors."""
    long = df.where("label >= 0").select("label", F.posexplode("v").alias("i", "x"))
    rows = long.groupBy("label", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).toPandas()
    out = Summary(np.zeros(k), np.zeros((k, d)), np.zeros((k, d)))
    at = rows["label"].to_numpy(), rows["i"].to_numpy()
    out.n[at[0]], out.s[at], out.q[at] = rows["n"], rows["s"], rows["q"]
    return out


def _sample_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    centres = seed_centres(x, k, np.random.default_rng(seed))
    for _ in range(100):
        own = distances(x, centres).argmin(1)
        then = np.stack([x[own == j].mean(0) if (own == j).any() else c for j, c in enumerate(centres)])
        if np.allclose(then, centres):
            break
        centres = then
    return centres


def bfr(df: DataFrame, k: int = 3, threshold: float = 2.0, merge_distance: float = 0.1, micro: int = 3, least: int = 5, rounds: int = 20, sample_size: int = 4096, seed: int = 42) -> DataFrame:
    """(id, label) of (id, v): -1 for vectors that no summary took in.

    The first summaries come from k-means over a seeded sample of at most
    sample_size vectors, drawn anew without those that make a cluster of their
    own, as such a summary has no spread. In each round all vectors are measured against the
    summaries at its start, and those under the threshold make the next ones,
    until no more vectors are taken in, or after `rounds`; in the end all are
    measured again. The others are split into k * micro groups by k-means, whose summaries are merged while two means
    are nearer than merge_distance, and become clusters where they have `least`
    members and lie beyond the threshold of all others; members of other
    groups of three or more go to the nearest summary, like all that were taken in. Order never
    matters: the result depends on ids and the seed alone. Fewer than k vectors
    are all -1; an empty table gives no rows.
    """
    ship_package(df.sparkSession)
    x = stack(hash_sample(df.select("id", "v"), "id", sample_size, seed).toPandas()["v"])
    if len(x) < k:
        return df.select("id", F.lit(-1).cast("int").alias("label"))
    while True:
        centres = _sample_means(x, k, seed)
        own = distances(x, centres).argmin(1)
        alone = np.bincount(own, minlength=len(centres))[own] == 1
        if not alone.any() or (~alone).sum() < k:
            break
        x = x[~alone]
    held, taken = Summary.of(x, own, len(centres)), -1
    for _ in range(rounds):
        part = _settled(df, held, threshold)
        then = _summary(part, len(held.n), x.shape[1])
        if then.n.sum() <= taken:
            break
        # A cluster that took in fewer than two keeps its summary.
        kept = then.n > 1
        taken = int(then.n.sum())
        held = Summary(np.where(kept, then.n, held.n), np.where(kept[:, None], then.s, held.s), np.where(kept[:, None], then.q, held.q))
    part = materialize(_settled(df, held, threshold), "bfr")
    left = part.where("label < 0").select("id", "v")
    compressed = None
    if left.limit(3).count() == 3:
        _, groups, _ = kmeans(left, k * micro, seed=seed)
        groups = materialize(groups, "bfr-groups")
        n = k * micro
        small = _summary(left.join(groups, "id"), n, x.shape[1])
        big = np.flatnonzero(small.n >= 3)
        compressed = groups.where(F.col("label").isin([int(i) for i in big])).select("id")
        small = small.pick(big)
        while len(small.n) > 1:
            gap = distances(small.means(), small.means())
            np.fill_diagonal(gap, np.inf)
            i, j = np.unravel_index(gap.argmin(), gap.shape)
            if gap[i, j] >= merge_distance:
                break
            into = np.arange(len(small.n))
            into[max(i, j)] = min(i, j)
            small = small.grouped(np.unique(into, return_inverse=True)[1], len(small.n) - 1)
        if len(small.n):
            fresh = (small.n >= least) & (held.distances(small.means()).min(1) >= threshold)
            new, old = small.pick(fresh), small.pick(~fresh)
            held = held.beside(new)
            if len(old.n):
                held = held + old.grouped(held.distances(old.means()).argmin(1), len(held.n))
    named = _settled(part, held, float("inf")).select("id", F.col("label").cast("int").alias("label"))
    inside = part.where("label >= 0").select("id")
    inside = inside if compressed is None else inside.union(compressed)
    return df.select("id").join(named.join(inside, "id", "left_semi"), "id", "left").na.fill(-1, ["label"])
