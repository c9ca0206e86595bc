"""Benchmark decontamination by winnowed fingerprints.

Both sides are fingerprinted by winnowing: of the hashes of `gram` consecutive
words, the least in every window is kept, and neighbouring windows with one
fingerprint make one row. Two texts that share a window share its fingerprint,
so a document's window can equal an item's only where its fingerprint is among
the items': these are joined. Only hits are extended to whole windows, whose
words are then compared by two 64-bit hashes from independent word hashes.

Items shorter than a window are one window of their own length, winnowed alike.
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
from minewright.runtime import materialize, ship_package

SPAN = 10
GRAM = 5
#: Characters of benchmark text up to which its index is broadcast (about 40 bytes of index for each word).
BROADCAST_CHARS = 8 << 20

_ITEMS = "item_id long, length int, fp long, h1 long, h2 long"


def _least(w: tc.Words, length: int, gram: int) -> np.ndarray:
    """At each position, the fingerprint of the window of `length` words that begins there."""
    k = min(gram, length // 2 + 1)
    return tc.sliding_min(w.grams(k), length - k + 1)


def prints(w: tc.Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number and fingerprint of each run of neighbouring windows that have one fingerprint."""
    at = w.inside(length)
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    least = _least(w, length, gram)[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    if length == 1:
        fresh |= np.isin(at, w.docs)
    first = np.flatnonzero(fresh)
    return at[first], np.diff(np.append(first, len(at))), least[first]


def _item_rows(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """One row for each window of each item; a short item is one window."""
    for batch in tc.chunks(batches):
        w = tc.words(batch.column("text"), tc.ALNUM, lower=True)
        ids = np.asarray(batch.column("item_id").to_numpy(zero_copy_only=False), np.int64)
        own = np.minimum(w.counts, span)
        for n in np.unique(own[own > 0]).tolist():
            at = w.inside(n)
            doc = w.doc_of[at]
            at, doc = at[own[doc] == n], doc[own[doc] == n]
            codes = (_least(w, n, gram)[at], w.runs(at, n, 0), w.runs(at, n, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[doc]), pa.array(np.full(len(at), n, np.int32)), *(pa.array(x.view(np.int64)) for x in codes)],
                ["item_id", "length", "fp", "h1", "h2"],
            )


class Index:
    """Windows of the items by length: their fingerprints, hashes, and items."""

    def __init__(self, rows: pa.Table, span: int, gram: int):
        self.gram, self.of_length = gram, {}
        item, length = (rows.column(c).to_numpy() for c in ("item_id", "length"))
        fp, h1, h2 = (np.ascontiguousarray(rows.column(c).to_numpy()).view(np.uint64) for c in ("fp", "h1", "h2"))
        for n in sorted(set(length.tolist())):
            own = np.flatnonzero(length == n)
            own = own[np.lexsort((item[own], h2[own], h1[own]))]
            one, two = h1[own], h2[own]
            begin = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            self.of_length[n] = np.unique(fp[own]), one[begin], two[begin], np.append(begin, len(own)), item[own]

    @staticmethod
    def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, x)
        at[at == len(keys)] = 0
        return keys[at] == x

    @staticmethod
    def _windows(one: np.ndarray, two: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each (h1, h2) among the sorted pairs (one, two), -1 if it is not there."""
        out = np.full(len(h1), -1)
        live, k = np.arange(len(h1)), np.searchsorted(one, h1)
        while len(live):
            near = k < len(one)
            near[near] = one[k[near]] == h1[live[near]]
            live, k = live[near], k[near]
            same = two[k] == h2[live]
            out[live[same]] = k[same]
            live, k = live[~same], k[~same] + 1
        return out

    def hits(self, w: tc.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each hit window, and (position, item) of each occurring item."""
        starts, lengths, where, items = [], [], [], []
        for n, (fps, one, two, begin, item) in self.of_length.items():
            first, many, fp = prints(w, n, self.gram)
            seed = self._among(fp, fps)
            at = tc.ragged(first[seed], many[seed])
            k = self._windows(one, two, w.runs(at, n, 0), w.runs(at, n, 1))
            at, k = at[k >= 0], k[k >= 0]
            count = begin[k + 1] - begin[k]
            starts.append(at)
            lengths.append(np.full(len(at), n))
            where.append(np.repeat(at, count))
            items.append(item[tc.ragged(begin[k], count)])
        empty = np.empty(0, np.int64)
        return tuple(np.concatenate(x) if x else empty for x in (starts, lengths, where, items))


_EXTRA = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.int64()))]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words lie in one of the given runs."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def per_doc(flags: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Number of true flags of each text."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[docs[1:]] - total[docs[:-1]]


def _scan(batches: Iterator[pa.RecordBatch], index: Broadcast) -> Iterator[pa.RecordBatch]:
    ix = index.value
    for batch in tc.chunks(batches):
        w = tc.words(batch.column("text"), tc.ALNUM, lower=True)
        starts, lengths, where, items = ix.hits(w)
        n_docs = batch.num_rows
        hit = per_doc(covered(len(w.starts), starts, lengths), w.docs)
        doc = np.searchsorted(w.docs, where, "right") - 1
        pairs = np.unique(np.stack([doc, items], 1), axis=0) if len(doc) else np.empty((0, 2), np.int64)
        cuts = np.searchsorted(pairs[:, 0], np.arange(n_docs + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(w.counts.astype(np.int64)),
                pa.array(hit.astype(np.int64)),
                pa.array(np.diff(cuts).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(pairs[:, 1])),
            ],
            ["doc_id", *(c for c, _ in _EXTRA)],
        )


def _doc_prints(batches: Iterator[pa.RecordBatch], gram: int, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """For an index too large to broadcast: the fingerprints of every document."""
    for batch in tc.chunks(batches):
        w = tc.words(batch.column("text"), tc.ALNUM, lower=True)
        key = batch.column("row").to_numpy()
        for n in lengths:
            at, many, fp = prints(w, n, gram)
            d = np.searchsorted(w.docs, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), n, np.int32)), pa.array(fp.view(np.int64)), pa.array(key[d]), pa.array((at - w.docs[d]).astype(np.int32)), pa.array(many.astype(np.int32))],
                ["length", "fp", "row", "start", "n"],
            )


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of all windows of the runs that are listed with a document."""
    for batch in tc.chunks(batches):
        w = tc.words(batch.column("text"), tc.ALNUM, lower=True)
        parts, key = batch.column("parts"), batch.column("row").to_numpy()
        flat = parts.flatten()
        length, start, many = (flat.field(c).to_numpy().astype(np.int64) for c in ("length", "start", "n"))
        doc = np.repeat(np.repeat(np.arange(batch.num_rows), parts.value_lengths().to_numpy()), many)
        length, start = np.repeat(length, many), tc.ragged(start, many)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            at = w.docs[doc[own]] + start[own]
            codes = (w.runs(at, n, 0), w.runs(at, n, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[doc[own]]), pa.array(start[own].astype(np.int32)), pa.array(np.full(len(own), n, np.int32)), *(pa.array(x.view(np.int64)) for x in codes)],
                ["row", "start", "length", "h1", "h2"],
            )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tc.chunks(batches):
        w = tc.words(batch.column("text"), tc.ALNUM, lower=True)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(w.counts.astype(np.int64))], ["row", "doc_id", "n_words"])


def _by_join(numbered: DataFrame, index: DataFrame, span: int, gram: int) -> DataFrame:
    """The same columns as of _scan for each row of numbered (row, doc_id, text), by shuffles alone, whatever the size of the benchmark.

    Only fingerprints are shuffled, and texts that share one with an item.
    """
    # At most `span` different lengths.
    lengths = tuple(r["length"] for r in index.select("length").distinct().collect())
    rows = numbered.select("row", "text").mapInArrow(partial(_doc_prints, gram=gram, lengths=lengths), "length int, fp long, row long, start int, n int")
    seeds = rows.join(index.select("length", "fp").distinct(), ["length", "fp"], "left_semi")
    parts = seeds.groupBy("row").agg(F.collect_list(F.struct("length", "start", "n")).alias("parts"))
    windows = numbered.select("row", "text").join(parts, "row").mapInArrow(_extended, "row long, start int, length int, h1 long, h2 long")
    found = materialize(windows.join(index.select("length", "h1", "h2").distinct(), ["length", "h1", "h2"], "left_semi"), "decon-hits")
    items = found.select("row", "length", "h1", "h2").distinct().join(index.select("length", "h1", "h2", "item_id").distinct(), ["length", "h1", "h2"])
    items = items.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    spans = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))
    # Words covered by the union of the spans, which come sorted by start.
    spans = spans.select(
        "row",
        F.expr(
            "aggregate(spans, named_struct('n', 0L, 'upto', 0), (a, s) -> named_struct("
            "'n', a.n + greatest(0, s.start + s.length - greatest(a.upto, s.start)), "
            "'upto', greatest(a.upto, s.start + s.length))).n"
        ).alias("n_hit"),
    )
    base = numbered.mapInArrow(_count_words, "row long, doc_id long, n_words long")
    return (
        base.join(spans, "row", "left")
        .join(items, "row", "left")
        .select(
            "row",
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        )
    )


def _keep(batches: Iterator[pa.RecordBatch], index: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in tc.chunks(batches):
        w = tc.words(batch.column("text"), tc.ALNUM, lower=True)
        starts = index.value.hits(w)[0]
        keep = np.ones(batch.num_rows, bool)
        keep[np.searchsorted(w.docs, starts, "right") - 1] = False
        yield batch.filter(pa.array(keep))


def _index(benchmark: DataFrame, span: int, gram: int, broadcast_chars: int) -> tuple[DataFrame, Broadcast | None]:
    """Rows of the items' windows, and their index if it is small enough to broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    rows = items.mapInArrow(partial(_item_rows, span=span, gram=gram), _ITEMS)
    if chars > broadcast_chars:
        return materialize(rows, "decon-index"), None
    return rows, benchmark.sparkSession.sparkContext.broadcast(Index(rows.toArrow(), span, gram))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows of docs, all columns, in which contamination() finds no item."""
    ship_package(docs.sparkSession)
    rows, index = _index(benchmark, span, gram, broadcast_chars)
    if index is not None:
        return docs.mapInArrow(partial(_keep, index=index), docs.schema)
    # Rows are known by number, so that those which share an id are judged one by one.
    whole = F.struct(*docs.columns).alias("given")
    numbered = materialize(docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id()), "decon-docs")
    hit = _by_join(numbered.select("row", "doc_id", "text"), rows, span, gram).where("n_hit > 0").select("row")
    return numbered.join(hit, "row", "left_anti").select("given.*")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Find the items of `benchmark` (item_id, text) inside `docs` (doc_id, text).

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters. An item is found where any `span` consecutive words of it
    occur, or all of them if it has fewer. Returns, for each row of docs,
    doc_id, n_words, n_hit (words inside an occurrence), n_items (different
    items found) and items (their ids, ascending).

    Null or empty texts have no words: such documents get zeros, such items
    are never found, as are items without an id. Repeated rows and equal ids
    are each treated on their own; items that share an id count once. Other
    columns of either table are not read. Empty tables give zeros or no rows.

    The index of the items is broadcast if their texts have at most
    broadcast_chars characters, and joined by shuffles otherwise; documents
    are read once and, in the first case, not shuffled.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, index = _index(benchmark, span, gram, broadcast_chars)
    if index is None:
        numbered = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "decon-docs")
        return _by_join(numbered, rows, span, gram).drop("row")
    return docs.mapInArrow(partial(_scan, index=index), "doc_id long, n_words long, n_hit long, n_items long, items array<long>")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from those of contamination()."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
