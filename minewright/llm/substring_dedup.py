"""Substring dedup: seeds on winnowed anchors, extended to all repeated windows.

A document's windows of `span` consecutive words are grouped by their anchor,
the least hash of the `gram`-word runs inside (winnowing: equal windows have
equal anchors). Consecutive windows with one anchor form a stretch, so that a
row is kept for some 13 words instead of one for each.

Seed: only anchors that occur in two documents go on. Extend: a stretch whose
whole extension to both sides (all its words) also occurs in an earlier
document is a repeat in full. Stretches that only part of can be repeated are
extended window by window, for one document of each different extension, so
copies in any number cost one row each and no pairs are formed. Overlapping
repeats join to maximal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm import textcodes as tc
from minewright.llm.decontaminate import covered, per_doc
from minewright.operators.skew import join_counted
from minewright.runtime import discard, materialize, ship_package

SPAN = 50
GRAM = 25


def _stretches(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in tc.chunks(batches):
        w = tc.words(batch.column("text"))
        at = w.inside(span)
        if not len(at):
            continue
        least = tc.sliding_min(w.grams(gram), span - gram + 1)[at]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(least.view(np.int64)) != 0)]))
        # windows of two documents are never neighbours: span - 1 positions lie between them, unless span is 1
        n = np.diff(np.append(first, len(at)))
        begin = at[first]
        doc = np.searchsorted(w.docs, begin, "right") - 1
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(doc)),
                batch.column("text_key").take(pa.array(doc)),
                pa.array(least[first].view(np.int64)),
                pa.array(w.spans(begin, begin + n + span - 1, 1).view(np.int64)),
                pa.array((begin - w.docs[doc]).astype(np.int32)),
                pa.array(n.astype(np.int32)),
            ],
            ["doc_id", "text_key", "anchor", "extent", "start", "n"],
        )


def _windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Hash of each window of the stretches listed with a document."""
    for batch in tc.chunks(batches):
        w = tc.words(batch.column("text"))
        parts = batch.column("parts")
        count = parts.value_lengths().to_numpy()
        flat = parts.flatten()
        doc = np.repeat(np.arange(batch.num_rows), count)
        start, n, anchor = (flat.field(c).to_numpy() for c in ("start", "n", "anchor"))
        offset = tc.ragged(start.astype(np.int64), n.astype(np.int64))
        doc, anchor = np.repeat(doc, n), np.repeat(anchor, n)
        at = w.docs[doc] + offset
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(doc)),
                batch.column("text_key").take(pa.array(doc)),
                pa.array(anchor),
                pa.array(w.runs(at, span, 1).view(np.int64)),
                pa.array(offset.astype(np.int32)),
            ],
            ["doc_id", "text_key", "anchor", "window", "start"],
        )


def _cut(batches: Iterator[pa.RecordBatch], span: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Remove the words of the listed windows; the rest joined by single spaces."""
    for batch in tc.chunks(batches):
        w = tc.words(batch.column("text"))
        parts = batch.column("parts")
        count = np.nan_to_num(parts.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = parts.flatten()
        doc = np.repeat(np.arange(batch.num_rows), count)
        start = flat.field("start").to_numpy() + w.docs[doc]
        gone = covered(len(w.starts), start, flat.field("n").to_numpy().astype(np.int64) + span - 1)
        keep = np.flatnonzero(~gone)
        size = w.ends[keep] - w.starts[keep] + 1
        # Each kept word with a space behind it; a text's last space is left out below.
        data = w.data
        source = tc.ragged(w.starts[keep], size)
        out = np.append(data, np.uint8(32))[np.minimum(source, len(data))]
        ends = np.cumsum(size)
        out[ends - 1] = 32
        at = np.searchsorted(keep, w.docs)
        edge = np.concatenate([[0], ends])[at]
        blob = out.tobytes()
        texts = [blob[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        columns = [
            batch.column("doc_id"),
            pa.array(w.counts.astype(np.int64)),
            pa.array(per_doc(gone, w.docs).astype(np.int64)),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        ]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array([t.decode() for t in texts], pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(columns, names)


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Runs of windows that also start in a document with a smaller id.

    Returns (doc_id, text_key, start, n): n windows of span words from word
    start on. docs needs doc_id, text and text_key.
    """
    stretch = "doc_id long, text_key long, anchor long, extent long, start int, n int"
    all_ = materialize(docs.where("doc_id is not null").mapInArrow(partial(_stretches, span=span, gram=gram), stretch), "sub-stretches")
    count = F.count(F.lit(1)).alias("rows")
    seeds = all_.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), count).where("a < b").select("anchor", "rows")
    seeds = materialize(seeds, "sub-anchors")
    hit = materialize(join_counted(all_, seeds, ["anchor"], all_.count(), "rows").drop("rows"), "sub-seeds")
    discard(all_, seeds)
    extents = materialize(hit.groupBy("anchor", "extent").agg(F.min("doc_id").alias("first_doc"), count), "sub-extents")
    known = materialize(join_counted(hit, extents, ["anchor", "extent"], hit.count(), "rows").drop("rows", "extent"), "sub-known")
    discard(hit)
    # What an earlier document has not in full may still be in part, if its anchor stands in other surroundings too.
    several = materialize(extents.groupBy("anchor").agg(count).where("rows > 1"), "sub-several")
    open_ = join_counted(known.where("doc_id = first_doc"), several, ["anchor"], extents.count(), "rows")
    parts = open_.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("parts"))
    windows = materialize(
        docs.join(parts, ["doc_id", "text_key"]).mapInArrow(
            partial(_windows, span=span), "doc_id long, text_key long, anchor long, window long, start int"
        ),
        "sub-windows",
    )
    discard(extents, several)
    earliest = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), count)
    earliest = materialize(earliest.where("first_doc < last_doc").drop("last_doc"), "sub-earliest")
    partly = join_counted(windows, earliest, ["anchor", "window"], windows.count(), "rows").where("doc_id > first_doc")
    whole = known.where("doc_id > first_doc").select("doc_id", "text_key", "start", "n")
    return whole.union(partly.select("doc_id", "text_key", "start", F.lit(1).alias("n")))


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Remove from each text the words of windows that an earlier document has.

    A word is a run of characters other than white space (0x20, 0x09-0x0D); a
    window is `span` consecutive words. Earlier means a smaller doc_id, and
    windows are judged on the input. Returns for each row doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by single spaces) and,
    with_text, kept_text.

    Null and empty texts have no words. Documents without an id lose nothing
    and count as earlier than none. Repeated rows, and rows that share an id,
    are compared with smaller ids alone, so they don't remove each other.
    Other columns are not read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    spans = repeats(docs, span, gram).distinct()
    per = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("parts"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return docs.join(per, ["doc_id", "text_key"], "left").mapInArrow(partial(_cut, span=span, with_text=with_text), schema)
