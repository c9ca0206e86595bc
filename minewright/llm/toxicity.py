"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and their beginnings (so that inflected forms share terms);
those associated with the label in the labelled sample are kept. The labelled
vectors form a block-max inverted index: examples lie in blocks, each term's
postings are stored block by block, and for each term and block the greatest
weight is kept. A text's blocks are visited in descending order of the bound
that these give, until no further block can reach the k-th best cosine, so the
neighbours are exact. Each votes with its cosine; a constant vote for the
class's share pulls texts without near examples there. What such a vote is
worth is learnt from the examples themselves, each judged by all others: a
logistic curve turns votes into calibrated scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm import textcodes as tc
from minewright.llm.labelled import Vocabulary, among, choose_terms, distinct_terms, fold, sample
from minewright.runtime import ship_package

#: Labelled rows of each class that the index may hold.
PER_CLASS = 6000
TERMS = 256
NEIGHBOURS = 15
PRIOR_VOTES = 0.5
CUT = 0.7
BLOCK = 64
#: Blocks that are looked into before the first test of bounds; each further step takes four times as many.
FIRST_BLOCKS = 8
#: Bytes of a word's beginnings that are terms; at most 8.
STEMS = (3, 4, 5, 6, 7, 8)
#: Different vectors whose votes a task keeps.
MEMO = 1 << 14


def extract(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (A-Z lower-cased) and their beginnings, with frequencies."""
    w = tc.words(texts, tc.ALNUM, lower=True)
    uniques, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
    size, block = w.sizes[first], tc.blocks(w.data)[w.starts[first]]
    # The terms of each different word come first, then only words with a wanted term are looked at.
    own, terms = [np.arange(len(first))], [uniques]
    for k in STEMS:
        long = np.flatnonzero(size >= k)
        own.append(long)
        terms.append(tc.mix((block[long] & np.uint64((1 << 8 * k) - 1)) ^ (tc.SALT >> np.uint64(k))))
    own, terms = np.concatenate(own), np.concatenate(terms)
    if known is not None:
        there = among(terms, known)[0]
        own, terms = own[there], terms[there]
    order = np.argsort(own, kind="stable")
    terms = terms[order]
    many = np.bincount(own, minlength=len(first))
    begin = np.cumsum(many) - many
    seen = np.flatnonzero(many[back])
    word = back[seen]
    return distinct_terms(np.repeat(w.doc_of[seen], many[word]), terms[tc.ragged(begin[word], many[word])])


class BlockMaxIndex:
    """Exact nearest examples of sparse unit vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, cuts: np.ndarray, columns: np.ndarray, weights: np.ndarray, n_terms: int):
        n = len(ids)
        # Examples with the same heaviest term lie together, which makes the bounds tight.
        heavy = np.full(n, n_terms)
        row = np.repeat(np.arange(n), np.diff(cuts))
        order = np.lexsort((weights, row))
        heavy[row[order]] = columns[order]
        place = np.lexsort((ids, labels, heavy))
        rank = np.empty(n, np.int64)
        rank[place] = np.arange(n)
        #: The place of each given example.
        self.rank = rank
        self.ids, self.labels = ids[place], labels[place]
        self.blocks = max(1, -(-n // BLOCK))
        doc = rank[row]
        order = np.lexsort((doc, columns))
        self.doc, self.weight, term = doc[order], weights[order], columns[order]
        block = self.doc // BLOCK
        self.begin = np.searchsorted(term * self.blocks + block, np.arange(n_terms * self.blocks + 1)).reshape(-1)
        self.most = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.most, (term, block), self.weight)

    def bounds(self, cuts: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each of several texts, what its cosine with any example of a block can reach."""
        x = np.zeros((len(cuts) - 1, len(self.most)))
        x[np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), columns] = weights
        return x @ self.most

    def nearest(self, columns: np.ndarray, weights: np.ndarray, k: int, bound: np.ndarray | None = None, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine, without place `but`.

        Cosines that agree to 12 places are ties, which go to the first places.
        """
        if bound is None:
            bound = weights @ self.most[columns]
        order = np.argsort(-bound, kind="stable")
        order = order[: int(np.count_nonzero(bound > 0))]
        place, cosine = np.empty(0, np.int64), np.empty(0)
        lo, step = 0, FIRST_BLOCKS
        while lo < len(order):
            hi = min(lo + step, len(order))
            if len(place) >= k:
                # Blocks come by descending bound: those from `hi` on can't reach the k-th best.
                hi = min(hi, lo + int(np.searchsorted(-bound[order[lo:hi]], 1e-9 - cosine[k - 1], "right")))
                if hi == lo:
                    break
            group = order[lo:hi]
            at = (columns[:, None] * self.blocks + group).ravel()
            count = self.begin[at + 1] - self.begin[at]
            posting = tc.ragged(self.begin[at], count)
            # A row of sums for each block of the group.
            slot = np.empty(self.blocks, np.int64)
            slot[group] = np.arange(len(group))
            doc = self.doc[posting]
            value = np.bincount(slot[doc // BLOCK] * BLOCK + doc % BLOCK, self.weight[posting] * np.repeat(np.repeat(weights, len(group)), count), len(group) * BLOCK)
            found = np.flatnonzero(value > 0)
            where = group[found // BLOCK] * BLOCK + found % BLOCK
            found, where = found[where != but], where[where != but]
            place = np.concatenate([place, where])
            cosine = np.concatenate([cosine, value[found]])
            if len(place) > k:
                rounded = np.round(cosine, 12)
                least = np.partition(rounded, len(rounded) - k)[len(rounded) - k]
                top = np.flatnonzero(rounded >= least)
                top = top[np.lexsort((place[top], -rounded[top]))[:k]]
            else:
                top = np.lexsort((place, -np.round(cosine, 12)))
            place, cosine = place[top], cosine[top]
            lo, step = hi, 4 * step
        return place, cosine


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float = 1.0, rounds: int = 50) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + exp(-a x - b)) fits y best; `prior` draws them towards (1, 0)."""
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones(len(x))], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - prior * (theta - [1.0, 0.0])
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + prior * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta = theta + step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


class Model:
    """Vocabulary, index, the classes' shares and weights, and the curve from votes to scores."""

    def __init__(self, vocabulary: Vocabulary, index: BlockMaxIndex | None, share: float, weight: tuple[float, float]):
        self.vocabulary, self.index, self.share, self.weight = vocabulary, index, share, weight
        self.curve = (1.0, 0.0)
        self.memo: dict[bytes, tuple[float, list[int]]] = {}

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        y = self.index.labels[place] == 1
        vote = cosine * np.where(y, self.weight[1], self.weight[0])
        return min(1.0, float((vote @ y + PRIOR_VOTES * self.share) / (vote.sum() + PRIOR_VOTES)))

    @staticmethod
    def _odds(votes: np.ndarray) -> np.ndarray:
        inside = np.clip(votes, 1e-3, 1 - 1e-3)
        return np.log(inside / (1 - inside))

    def calibrate(self, cuts: np.ndarray, columns: np.ndarray, weights: np.ndarray, y: np.ndarray, place: np.ndarray) -> None:
        """Fit the curve to the examples, each judged by all others."""
        if len(set(y.tolist())) < 2:
            return
        votes, bound = np.full(len(y), self.share), self.index.bounds(cuts, columns, weights)
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[i], cuts[i + 1])
            votes[i] = self.vote(*self.index.nearest(columns[own], weights[own], NEIGHBOURS, bound[i], int(place[i])))
        # Examples weigh what they stand for among all labelled rows.
        weight = np.where(y == 1, self.weight[1], self.weight[0])
        self.curve = logistic(self._odds(votes), (y == 1).astype(float), weight * len(y) / weight.sum())

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        votes, evidence = np.full(len(texts), self.share), [[] for _ in range(len(texts))]
        if self.index is None or not len(self.vocabulary):
            return votes, evidence
        cuts, columns, weights = self.vocabulary.vectors(texts, extract)
        some = np.flatnonzero(np.diff(cuts))
        bound = self.index.bounds(np.append(cuts[some], cuts[-1]), columns, weights)
        if len(self.memo) > MEMO:
            self.memo.clear()
        for d, top in zip(some.tolist(), bound, strict=True):
            own = slice(cuts[d], cuts[d + 1])
            key = columns[own].tobytes() + weights[own].tobytes()
            if key not in self.memo:
                place, cosine = self.index.nearest(columns[own], weights[own], NEIGHBOURS, top)
                self.memo[key] = self.vote(place, cosine), self.index.ids[place].tolist()
            votes[d], evidence[d] = self.memo[key]
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * self._odds(votes) + b))), evidence


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in tc.chunks(batches):
        cuts, columns, weights = vocabulary.vectors(batch.column("text"), extract)
        at = pa.array(cuts.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(at, pa.array(columns.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(weights))],
            ["doc_id", "y", "columns", "weights"],
        )


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", per_class: int = PER_CLASS) -> Model:  # noqa: ANN001
    rows, shares = sample(docs, labels, label, held_out, per_class)
    vocabulary = choose_terms(rows, extract, TERMS)
    share = shares.get(1, 0.0) if shares else 0.5
    if not len(vocabulary):
        return Model(vocabulary, None, share, (1.0, 1.0))
    # At most 2 * per_class vectors over TERMS terms.
    got = rows.mapInArrow(partial(_vectors, vocabulary=vocabulary), "doc_id long, y int, columns array<int>, weights array<double>").toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    y = got.column("y").to_numpy()
    lists = got.column("columns").combine_chunks()
    cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    columns, weights = lists.flatten().to_numpy().astype(np.int64), got.column("weights").combine_chunks().flatten().to_numpy()
    index = BlockMaxIndex(got.column("doc_id").to_numpy(), y, cuts, columns, weights, len(vocabulary))
    # A class that was sampled more thinly weighs more.
    size = [max(1, int((y == c).sum())) for c in (0, 1)]
    weight = [shares.get(c, 0.0) / size[c] for c in (0, 1)]
    top = max(weight) or 1.0
    model = Model(vocabulary, index, share, (weight[0] / top, weight[1] / top))
    model.calibrate(cuts, columns, weights, y, index.rank)
    return model


def _apply(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in tc.chunks(batches):
        score, evidence = model.value.score(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))],
            [*(c for c in batch.schema.names if c != "text"), "score", "predicted", "evidence"],
        )
    model.value.memo.clear()


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, per_class: int = PER_CLASS) -> DataFrame:
    """Score every text of docs (doc_id, text) by labels (doc_id, toxic).

    Rows whose crc32(doc_id as text) mod `modulus` is `remainder` are held out
    of learning; at most per_class labelled rows of each class are learned
    from. Returns for each row doc_id, held_out, score (0 to 1), predicted (1
    from a score of 0.7) and evidence (ids of the nearest labelled examples).

    Null, empty and neutral texts have no evidence; their vote is the share of
    label 1 among the labelled rows, and their score what the curve makes of
    it. Without labels all score 0.5. Of labelled examples that are equally
    near, those that come first in the index vote. Null ids are not held out.
    Repeated rows score alike. Only the text is scored; other columns are not
    read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(train(docs, labels, fold("doc_id", modulus, remainder), per_class=per_class))
    given = docs.select("doc_id", fold("doc_id", modulus, remainder).alias("held_out"), "text")
    return given.mapInArrow(partial(_apply, model=model), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def _keep(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in tc.chunks(batches):
        yield batch.filter(pa.array(model.value.score(batch.column("text"))[0] < CUT))
    model.value.memo.clear()


def drop_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs, all columns, that score_toxicity doesn't predict 1 for."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, fold("doc_id", modulus, remainder), per_class=per_class))
    return docs.mapInArrow(partial(_keep, model=model), docs.schema)
