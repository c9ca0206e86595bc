"""Information-theoretic sanitisation of personal data.

Personal data of four kinds is found by pattern. Beyond that, a term can give
an entity away by itself: from all contexts in the corpus in which an entity
stands, and from the term's frequency in all documents, the pointwise mutual
information of term and entity is estimated. A term discloses an entity where
that reaches `threshold` of the entity's own information content; in documents
that hold the entity it is removed if it gives away nearly all, and generalised
otherwise. Entities, terms and pairs are all counted in documents, copies
included, so that copying a document changes no ratio of them. Every pair is
scored, those seen once too: the share of a term's occurrences that stand beside
the entity is drawn towards the entity's own share of all documents by `prior`
occurrences, so that few occurrences weigh less and frequent words next to an
entity by chance don't count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm import textcodes as tc
from minewright.runtime import discard, materialize, ship_package

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
WINDOW = 6
PRIOR = 0.5
THRESHOLD = 0.8
REMOVE = 0.95
#: One document in so many gives the first, lower bound of a term's frequency.
PART = 8
#: (entity, term) pairs, or terms, up to which a set is broadcast (24 bytes each).
BROADCAST_ROWS = 500_000

# An address's part from the sign on; what stands before it is found backwards.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match can begin inside a run of digits, and none gives digits back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in code points, ordered by start, then kind."""
    out = []
    if "@" in text:
        upto = 0
        for m in _AT.finditer(text):
            at = lo = m.start()
            while lo > upto and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at:
                out.append((lo, 0, m.end()))
                upto = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NON_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NON_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def entity(text: str, span: tuple[int, int, int]) -> int:
    """A 63-bit key of what a span says, whatever its case and separators."""
    said = text[span[0] : span[2]]
    said = said.lower() if span[1] <= 1 else _NON_DIGIT.sub("", said)
    return int.from_bytes(hashlib.blake2b(f"{span[1]}:{said}".encode(), digest_size=8).digest(), "little") >> 1


def _texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if t is None else t for t in batch.column("text").to_pylist()]


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with blanks in place of the spans."""
    out, upto = [], 0
    for s, _, e in spans:
        if e > upto:
            out += [text[upto : max(s, upto)], " " * (e - max(s, upto))]
            upto = e
    return "".join(out) + text[upto:]


def _contexts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(entity, term, n): number of documents with each entity, and with each term in a context of it, by batches.

    A context is the `window` words before and behind a span, however far off;
    other spans hold no words.
    """
    for batch in tc.chunks(batches):
        entities, owners, begins, masked = [], [], [], []
        for text in _texts(batch):
            if spans := find(text):
                entities += [entity(text, s) for s in spans]
                owners += [len(masked)] * len(spans)
                begins += [s for s, _, _ in spans]
                masked.append(_masked(text, spans))
        if not masked:
            continue
        w = tc.words(pa.array(masked, pa.string()), tc.ALNUM, lower=True)
        point = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        key, owner = np.array(entities, np.int64), np.array(owners, np.int64)
        behind = np.searchsorted(point[w.starts], point[w.bounds[owner]] + np.array(begins, np.int64))
        lo, hi = np.maximum(behind - window, w.docs[owner]), np.minimum(behind + window, w.docs[owner + 1])
        # A row with term 0 stands for the entity itself.
        at = np.concatenate([np.arange(len(key)), np.repeat(np.arange(len(key)), hi - lo)])
        term = np.concatenate([np.zeros(len(key), np.int64), w.hashes[tc.ragged(lo, hi - lo)].view(np.int64)])
        seen = np.unique(np.stack([key[at], term, owner[at]], 1), axis=0)
        pairs, n = np.unique(seen[:, :2], axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n.astype(np.int64))], ["entity", "term", "n"])


def _frequency(batches: Iterator[pa.RecordBatch], wanted: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Number of documents with each term, by batches; of wanted terms (few enough for a table), by tasks."""
    keys = None if wanted is None else wanted.value
    total = None if keys is None else np.zeros(len(keys), np.int64)
    for batch in tc.chunks(batches):
        w = tc.words(batch.column("text"), tc.ALNUM, lower=True)
        term, doc = w.hashes, w.doc_of
        if keys is not None:
            at = np.minimum(np.searchsorted(keys, term), len(keys) - 1)
            own = keys[at] == term
            term, doc = at[own], doc[own]
        order = np.lexsort((doc, term))
        term, doc = term[order], doc[order]
        fresh = np.ones(len(term), bool)
        fresh[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        terms, count = np.unique(term[fresh], return_counts=True)
        if total is not None:
            total[terms] += count
        else:
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(count.astype(np.int64))], ["term", "df"])
    if total is not None:
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[found].view(np.int64)), pa.array(total[found])], ["term", "df"])


def disclosures(docs: DataFrame, window: int = WINDOW, prior: float = PRIOR, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(entity, term, share): terms that disclose an entity, and how much of its information.

    A share falls as the term's frequency grows. So frequencies are counted in
    two steps: what one document in PART has bounds a term's frequency from
    below, and pairs whose share is too low even so (those of common words) are
    settled. Only the terms of the others are counted in all documents.
    """
    seen = docs.select("text").mapInArrow(partial(_contexts, window=window), "entity long, term long, n long")
    pairs = materialize(seen.groupBy("entity", "term").agg(F.sum("n").alias("n")), "pii-pairs")
    entities = pairs.where("term = 0").select("entity", F.col("n").alias("n_entity"))
    both = materialize(pairs.where("term <> 0").join(entities, "entity"), "pii-both")
    n = max(1, docs.count())
    information = F.log(F.lit(float(n)) / F.col("n_entity"))
    base = F.col("n_entity") / float(n)
    df = F.coalesce("df", F.lit(0))
    pmi = F.log((F.col("n") + prior * base) / (F.greatest(df, "n") + prior) / base)
    share = F.when(information > 0, pmi / information).otherwise(0.0)
    for texts in (docs.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0), docs):
        counted = _frequencies(texts.select("text"), both.select("term").distinct(), broadcast_rows)
        then = both.join(counted, "term", "left").withColumn("share", share).where(f"share >= {threshold}")
        then = materialize(then.select("entity", "term", "n", "n_entity", "share"), "pii-both")
        discard(both)
        both = then.drop("share")
    return then.select("entity", "term", F.least("share", F.lit(1.0)).alias("share"))


def _frequencies(texts: DataFrame, terms: DataFrame, broadcast_rows: int) -> DataFrame:
    """(term, df): in how many of the texts each of the given terms stands; terms that are in none may be absent."""
    spark = texts.sparkSession
    wanted = None
    if terms.limit(broadcast_rows + 1).count() <= broadcast_rows:
        got = terms.toArrow().column("term").combine_chunks()
        keys = np.sort(np.ascontiguousarray(got.to_numpy()).view(np.uint64))
        if not len(keys):
            return spark.createDataFrame([], "term long, df long")
        wanted = spark.sparkContext.broadcast(keys)
    counts = texts.mapInArrow(partial(_frequency, wanted=wanted), "term long, df long")
    if wanted is None:
        counts = counts.join(terms, "term", "left_semi")
    return counts.groupBy("term").agg(F.sum("df").alias("df"))


class Disclosed:
    """Flagged (entity, term) pairs for look-ups by entity."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("entity", "ascending"), ("term", "ascending")]).combine_chunks()
        self.entity = rows.column("entity").to_numpy()
        self.term = np.ascontiguousarray(rows.column("term").to_numpy()).view(np.uint64)
        self.share = rows.column("share").to_numpy()

    def of(self, entities: list[int]) -> dict[int, float]:
        out: dict[int, float] = {}
        for e in set(entities) if len(self.entity) else ():
            lo, hi = np.searchsorted(self.entity, [e, e + 1])
            for t, s in zip(self.term[lo:hi].tolist(), self.share[lo:hi].tolist(), strict=True):
                out[t] = max(s, out.get(t, 0.0))
        return out


def _replacement(kind: int, said: str, share: float) -> str:
    if kind < TERM:
        return f"[{KINDS[kind].upper()}]"
    if share >= REMOVE:
        return ""
    return "[number]" if said[:1].isdigit() else "[Name]" if said[:1].isupper() else "[word]"


def _sanitise(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """The text with spans replaced; of overlapping ones, the first stands for all."""
    out, upto = [], 0
    for s, kind, e, share in spans:
        if s >= upto:
            out += [text[upto:s], _replacement(kind, text[s:e], share)]
        upto = max(upto, e)
    return "".join(out) + text[upto:]


def _join(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "term")
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


#: Columns of the result, and those of a batch that aren't carried along.
_OWN = ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "sanitised", "text", "flagged", "text_key")


def _apply(batches: Iterator[pa.RecordBatch], flagged: Broadcast | None, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in tc.chunks(batches):
        texts = _texts(batch)
        base = [find(t) for t in texts]
        if flagged is not None:
            terms = [flagged.value.of([entity(t, s) for s in b]) if b else {} for t, b in zip(texts, base, strict=True)]
        else:
            listed = batch.column("flagged").to_pylist()
            terms = [{f["term"] & (1 << 64) - 1: f["share"] for f in x or ()} for x in listed]
        extra: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        if any(terms):
            w = tc.words(batch.column("text"), tc.ALNUM, lower=True)
            point = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
            for d, own in enumerate(terms):
                if not own:
                    continue
                lo, hi = int(w.docs[d]), int(w.docs[d + 1])
                hit = lo + np.flatnonzero(np.isin(w.hashes[lo:hi], np.array(list(own), np.uint64)))
                first = point[w.bounds[d]]
                for i in hit.tolist():
                    s, e = int(point[w.starts[i]] - first), int(point[w.ends[i]] - first)
                    if not any(a < e and s < b for a, _, b in base[d]):
                        extra[d].append((s, TERM, e, own[int(w.hashes[i])]))
        counts = np.array([[sum(k == kind for _, k, _ in b) for kind in range(TERM)] for b in base], np.int64).reshape(-1, TERM)
        every = [sorted([(*s, 1.0) for s in b] + x) for b, x in zip(base, extra, strict=True)]
        columns = [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(TERM))]
        names = ["doc_id", *(f"n_{k}" for k in KINDS)]
        columns += [pa.array([hashlib.sha256(_join(b).encode()).hexdigest() for b in base]), pa.array([_join([s[:3] for s in x]) for x in every], pa.string())]
        names += ["base_sha256", "spans"]
        if with_text:
            carried = [c for c in batch.schema.names if c not in _OWN]
            columns += [batch.column(c) for c in carried]
            names += carried
            given = batch.column("text").is_null().to_pylist()
            columns.append(pa.array([None if g else _sanitise(t, x) for g, t, x in zip(given, texts, every, strict=True)], pa.string()))
            names.append("sanitised")
        yield pa.RecordBatch.from_arrays(columns, names)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tc.chunks(batches):
        keys, names = batch.column("text_key").to_pylist(), []
        for key, text in zip(keys, _texts(batch), strict=True):
            names += {(key, entity(text, s)) for s in find(text)}
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in names], pa.int64()), pa.array([e for _, e in names], pa.int64())], ["text_key", "entity"])


def sanitise(
    docs: DataFrame,
    window: int = WINDOW,
    prior: float = PRIOR,
    threshold: float = THRESHOLD,
    with_text: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Find personal data, and terms that disclose it, in docs (doc_id, text).

    Returns for each row doc_id, n_email, n_ip, n_card, n_phone, base_sha256
    (of the pattern-found spans, kind:start:end, comma-joined) and spans (all
    of them, with terms of kind "term"); with_text, also sanitised, the text
    with spans replaced, and the other columns of docs, but for those named
    like one of the result.

    Positions are code points, ends exclusive. Null and empty texts have no
    spans (a null text stays null). Null ids and repeated rows stay as they
    are, and each row counts as a document. An empty table gives no rows. Three
    passes over the texts and no shuffle of them; disclosing pairs are
    broadcast up to broadcast_rows, and joined to the documents beyond that.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", "text", *(c for c in docs.columns if with_text and c not in _OWN))
    flagged = materialize(disclosures(docs, window, prior, threshold, broadcast_rows), "pii-flagged")
    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])
    if with_text:
        schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in _OWN) + ", sanitised string"
    if flagged.limit(broadcast_rows + 1).count() <= broadcast_rows:
        known = spark.sparkContext.broadcast(Disclosed(flagged.toArrow()))
        return docs.mapInArrow(partial(_apply, flagged=known, with_text=with_text), schema)
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    named = keyed.select("text_key", "text").mapInArrow(_entities, "text_key long, entity long").distinct()
    terms = named.join(flagged, "entity").groupBy("text_key", "term").agg(F.max("share").alias("share"))
    terms = terms.groupBy("text_key").agg(F.collect_list(F.struct("term", "share")).alias("flagged"))
    return keyed.join(terms, "text_key", "left").drop("text_key").mapInArrow(partial(_apply, flagged=None, with_text=with_text), schema)
