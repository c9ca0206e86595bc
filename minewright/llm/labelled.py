"""Bounded labelled samples and the terms that tell their classes apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm import textcodes as tc
from minewright.runtime import materialize

#: (text number, term, frequency) of each different term of each text of a batch; of known terms (ascending) alone if they are given.
Extract = Callable[[pa.Array, np.ndarray | None], tuple[np.ndarray, np.ndarray, np.ndarray]]


def fold(id_column: str, modulus: int, remainder: int):  # noqa: ANN201
    """Whether a row is held out: crc32 of the id as text has that remainder."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out, per_class: int) -> tuple[DataFrame, dict[int, float]]:  # noqa: ANN001
    """Texts of at most per_class labelled rows of each class, and each class's share of all labelled rows.

    Rows that are held out, or have no id or label, are never used. An id
    with several labels counts as 1 if any of them is 1. The rows are those
    with the least hash of their id, so they depend on the ids alone. An id
    stands for one row: of its texts, the one with the least hash.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(f"doc_id is not null and y in (0, 1)").where(~held_out)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    chosen = materialize(chosen, "label-ids")
    # At most 2 * per_class ids of 12 bytes.
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"))).alias("text"))
    n = sum(totals.values())
    return materialize(rows, "label-texts"), {y: c / n for y, c in totals.items()} if n else {}


def distinct_terms(doc: np.ndarray, term: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies of the terms of each text."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    weight = np.ones(len(doc), np.int64) if weight is None else weight[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], term[at], np.add.reduceat(weight, at) if len(at) else weight[:0]


def among(x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of x is one of the ascending keys, and its place there."""
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x, at


def _document_frequency(batches: Iterator[pa.RecordBatch], extract: Extract) -> Iterator[pa.RecordBatch]:
    for batch in tc.chunks(batches):
        y = batch.column("y").to_numpy()
        doc, term, _ = extract(batch.column("text"), None)
        terms, back = np.unique(term, return_inverse=True)
        ones = np.bincount(back, y[doc] == 1, len(terms)).astype(np.int64)
        both = np.bincount(back, minlength=len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(both - ones), pa.array(ones)], ["term", "n0", "n1"])


class Vocabulary:
    """Chosen terms, ascending by hash, with their idf over the sample."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.idf = terms[order], idf[order]

    def __len__(self) -> int:
        return len(self.terms)

    def vectors(self, texts: pa.Array, extract: Extract) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors of texts as sparse rows: cuts, columns, weights."""
        doc, term, tf = extract(texts, self.terms)
        at = np.searchsorted(self.terms, term)
        weight = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt(np.bincount(doc, weight * weight, len(texts)))
        weight = weight / norm[doc]
        return np.searchsorted(doc, np.arange(len(texts) + 1)), at, weight


def choose_terms(rows: DataFrame, extract: Extract, most: int, least_docs: int = 3, evidence: float = 15.0) -> Vocabulary:
    """The `most` terms most strongly associated with the label in a sample, by the G-squared statistic.

    Terms in fewer than least_docs texts, or under `evidence`, are left out.
    """
    counts = rows.mapInArrow(partial(_document_frequency, extract=extract), "term long, n0 long, n1 long")
    counts = counts.groupBy("term").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).where(f"a + b >= {least_docs}")
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = float(size.get(0, 0)), float(size.get(1, 0))
    n = max(n0 + n1, 1.0)

    def cell(seen, row, column):  # noqa: ANN001, ANN202
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    a, b = F.col("a"), F.col("b")
    g = 2 * (cell(a, a + b, F.lit(n0)) + cell(b, a + b, F.lit(n1)) + cell(n0 - a, n - a - b, F.lit(n0)) + cell(n1 - b, n - a - b, F.lit(n1)))
    best = counts.withColumn("g", g).where(F.col("g") >= evidence).orderBy(F.desc("g"), "term").limit(most).select("term", "a", "b").toArrow()
    term = np.ascontiguousarray(best.column("term").to_numpy()).view(np.uint64)
    df = best.column("a").to_numpy() + best.column("b").to_numpy()
    return Vocabulary(term, np.log((1 + n) / (1 + df)) + 1)
