"""Quality by votes of the nearest labelled documents in a latent semantic space.

Terms describe how a text is written: the shape of each word (runs of upper
case, lower case and digits, with other signs kept), pairs of neighbouring
shapes, repeated words, and words. Those associated with the label in the
labelled sample make TF-IDF vectors, which a truncated singular value
decomposition maps to a latent space. The labelled vectors are broadcast, and
the cosine of every document with all of them is computed in blocks; the k
nearest vote, weighted by similarity.
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

#: Labelled rows of each class that the model may hold.
PER_CLASS = 2000
TERMS = 1024
RANK = 48
NEIGHBOURS = 15
CUT = 0.7

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A] = ord("0")
_CLASS[0x41:0x5B] = ord("A")
_CLASS[0x61:0x7B] = ord("a")
_CLASS[0x80:] = ord("a")


def extract(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shapes, pairs of shapes, repetitions and words, with frequencies."""
    w = tc.words(texts)
    doc = w.doc_of
    n = len(w.starts)
    if not n:
        return doc, np.empty(0, np.uint64), doc
    kind = _CLASS[w.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[w.starts] = True
    shape = tc.Words(kind[keep], np.concatenate([[0], np.cumsum(keep)])[w.bounds], tc.NON_SPACE, False).hashes
    same = doc[1:] == doc[:-1]
    pair = tc.mix(shape[:-1] * np.uint64(3) + shape[1:])[same]
    echo = np.full(n - 1, 1, np.uint64)[same & (w.hashes[1:] == w.hashes[:-1])]
    echoing = doc[1:][same & (w.hashes[1:] == w.hashes[:-1])]
    docs, terms = np.concatenate([doc, doc[1:][same], echoing, doc]), np.concatenate([tc.mix(shape ^ tc.SALT), pair, echo, w.hashes])
    if known is not None:
        own = among(terms, known)[0]
        docs, terms = docs[own], terms[own]
    return distinct_terms(docs, terms)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest values of each row; of values that agree to 1e-12, the first."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, 1).min(1)
    for i in np.flatnonzero((cosine >= least[:, None] - 1e-12).sum(1) > k).tolist():
        above = np.flatnonzero(cosine[i] > least[i] + 1e-12)
        tied = np.flatnonzero(np.abs(cosine[i] - least[i]) <= 1e-12)
        near[i] = np.concatenate([above, tied[: k - len(above)]])
    return near


class Model:
    """Term vectors' projection to the latent space, and the labelled examples in it."""

    def __init__(self, vocabulary: Vocabulary, axes: np.ndarray, examples: np.ndarray, y: np.ndarray, weight: np.ndarray, share: float):
        self.vocabulary, self.axes, self.examples, self.y, self.weight, self.share = vocabulary, axes, examples, y, weight, share

    def latent(self, texts: pa.Array) -> np.ndarray:
        cuts, columns, weights = self.vocabulary.vectors(texts, extract)
        x = np.zeros((len(texts), len(self.vocabulary)))
        x[np.repeat(np.arange(len(texts)), np.diff(cuts)), columns] = weights
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(self.examples):
            return np.full(len(texts), self.share)
        out = np.empty(len(texts))
        for lo in range(0, len(texts), 512):
            cosine = self.latent(texts.slice(lo, 512)) @ self.examples.T
            near = nearest(cosine, min(NEIGHBOURS, cosine.shape[1]))
            vote = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 2 * self.weight[near]
            out[lo : lo + 512] = ((vote * self.y[near]).sum(1) + 1e-3 * self.share) / (vote.sum(1) + 1e-3)
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", per_class: int = PER_CLASS) -> Model:  # noqa: ANN001
    rows, shares = sample(docs, labels, label, held_out, per_class)
    vocabulary = choose_terms(rows, extract, TERMS)
    got = rows.mapInArrow(partial(_rows, vocabulary=vocabulary), "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id").combine_chunks()
    y = got.column("y").to_numpy().astype(float)
    share = shares.get(1, 0.5)
    if not len(vocabulary) or not len(y):
        return Model(vocabulary, np.zeros((len(vocabulary), 1)), np.empty((0, 1)), y, y, share)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    gram = x.T @ x
    values, vectors = np.linalg.eigh(gram)
    axes = vectors[:, np.argsort(-values)[: min(RANK, len(values))]]
    z = x @ axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    size = [max(1, int((y == c).sum())) for c in (0, 1)]
    weight = np.where(y == 1, shares.get(1, 0.0) / size[1], shares.get(0, 0.0) / size[0])
    return Model(vocabulary, axes, z, y, weight / weight.max(), share)


def _rows(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in tc.chunks(batches):
        cuts, columns, weights = vocabulary.vectors(batch.column("text"), extract)
        x = np.zeros((batch.num_rows, len(vocabulary)))
        x[np.repeat(np.arange(batch.num_rows), np.diff(cuts)), columns] = weights
        at = (np.arange(batch.num_rows + 1) * len(vocabulary)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], ["doc_id", "y", "x"])


def _apply(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in tc.chunks(batches):
        score = model.value.score(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, per_class: int = PER_CLASS) -> DataFrame:
    """Score every text of docs (doc_id, text) by labels (doc_id, quality).

    Rows whose crc32(doc_id as text) mod `modulus` is `remainder` are held out
    of learning; at most per_class labelled rows of each class are learned
    from. Returns for each row doc_id, held_out, score (0 to 1) and predicted
    (1 from a score of 0.7).

    Null, empty and blank texts have no terms and score the share of label 1
    among the labelled rows (0.5 without labels). Of labelled documents that
    are equally near, those with the smaller ids vote. Null ids are not held
    out. Repeated rows score alike. Only the text is scored; other columns are not
    read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(train(docs, labels, fold("doc_id", modulus, remainder), per_class=per_class))
    given = docs.select("doc_id", fold("doc_id", modulus, remainder).alias("held_out"), "text")
    return given.mapInArrow(partial(_apply, model=model), "doc_id long, held_out boolean, score double, predicted int")
