"""Sequence packing by non-negative least squares over length combinations.

Documents are tokenized and cut into windows of `length` tokens; what is left
of each is put into a histogram of lengths. All combinations of up to three
lengths that fill a window are enumerated, non-negative least squares finds how
often each is wanted, the counts are rounded down, and the residual pieces are
laid end to end: into the small slack of the combinations first, then into
windows of their own. What remains of a unit is cut to powers of two, the only
sequences that are not `length` long, so there is no padding at all.

A unit is a bounded run of one input partition. Every unit solves its own
histogram, so nothing is shuffled, and a lost task repeats only its own rows.
"""

from __future__ import annotations

import os
import warnings
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm import textcodes as tc
from minewright.runtime import ship_package

LENGTH = 4096
END_ID = 2
GRAIN = 32
#: Tokens packed together: about 1000 sequences; and tokens of pieces that leave together.
UNIT_TOKENS = 4 << 20
SEND_TOKENS = 1 << 18
#: Distinct words, and bytes of words, whose ids a task keeps.
MEMO_WORDS = 1 << 19
MEMO_BYTES = 16 << 20

#: Words encoded by one call.
GROUP = 64
#: Bytes between which words may part: letters and digits, and punctuation but the apostrophe.
SAID = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
MARKS = np.array([0x20 < b < 0x7F and not chr(b).isalnum() and chr(b) != "'" for b in range(256)])


class WordTokenizer:
    """Ids of whole texts from the ids of their words between ASCII white space.

    Right for tokenizers that never join characters across white space and
    drop it. Words also part between an ASCII letter or digit and ASCII
    punctuation, but for the apostrophe, if the tokenizer is seen to do so
    itself. Each different word is encoded once for each task; a word is known
    by its bytes, and its hash only says where to look.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # No cut may lie within a token that the tokenizer finds before it splits texts.
        whole = {c for x in self.tokenizer.get_added_tokens_decoder().values() for c in x.content}
        marks = MARKS & ~np.array([chr(b) in whole for b in range(256)])
        self.cut = (SAID, marks) if self._parts_marks(marks) else None
        bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        self.clear()

    def _parts_marks(self, marks: np.ndarray) -> bool:
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        tails = [a + b + c for a in map(chr, np.flatnonzero(marks)) for b in ("", *map(chr, np.flatnonzero(marks)), "'") for c in ("", "s")]
        # Were a tail joined with what stands before it, its ids would differ.
        return all(ids(head + tail) == ids(head) + ids(tail) for head in ("the", "K", "7") for tail in tails)

    def clear(self) -> None:
        self.words = np.empty(0, np.uint64)
        self.begin = self.count = self.said = self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.bytes = np.empty(0, np.uint8)

    def _encode(self, w: tc.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at the given places, and how many each has."""
        raw = w.data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
        ids, count = np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        plain = [i for i, x in enumerate(texts) if self.bar is not None and "|" not in x]
        # Words go in groups with a bar behind each, whose id tells where each ends.
        groups = [" | ".join([texts[i] for i in plain[a : a + GROUP]]) + " |" for a in range(0, len(plain), GROUP)]
        if groups:
            got = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)])
            ends = np.flatnonzero(got == self.bar)
            if len(ends) == len(plain):
                ids, count[plain] = got[got != self.bar], np.diff(ends, prepend=-1) - 1
            else:
                plain = []
        if len(plain) == len(texts):
            return ids, count
        # The others go one by one, and all are put in order.
        alone = np.ones(len(texts), bool)
        alone[plain] = False
        got = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in np.flatnonzero(alone).tolist()], add_special_tokens=False)]
        count[alone] = [len(x) for x in got]
        out = np.empty(int(count.sum()), np.uint32)
        mine = np.repeat(alone, count)
        out[mine], out[~mine] = [i for x in got for i in x], ids
        return out, count

    def _learn(self, w: tc.Words, fresh: np.ndarray) -> None:
        ids, count = self._encode(w, fresh)
        size = w.sizes[fresh]
        begin, said = len(self.ids) + np.cumsum(count) - count, len(self.bytes) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        self.bytes = np.concatenate([self.bytes, w.data[tc.ragged(w.starts[fresh], size)]])
        order = np.argsort(np.concatenate([self.words, w.hashes[fresh]]), kind="stable")
        self.words = np.concatenate([self.words, w.hashes[fresh]])[order]
        self.begin, self.count = np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]
        self.said, self.size = np.concatenate([self.said, said])[order], np.concatenate([self.size, size])[order]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.words, hashes)
        inside = at < len(self.words)
        inside[inside] = self.words[at[inside]] == hashes[inside]
        return at, inside

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and where each begins."""
        w = tc.words(texts, cut=self.cut)
        if len(self.words) > MEMO_WORDS or len(self.bytes) > MEMO_BYTES:
            self.clear()
        first, back = w.distinct()
        key = w.hashes[first]
        _, known = self._find(key)
        new = np.flatnonzero(~known)
        new = new[np.unique(key[new], return_index=True)[1]]
        if len(new):
            self._learn(w, first[new])
        at, _ = self._find(key)
        ids, begin, count = self.ids, self.begin[at], self.count[at]
        # Another word with the same hash is encoded by itself.
        size = w.sizes[first]
        other = self.size[at] != size
        same = np.flatnonzero(~other)
        other[same] = ~tc.equal_bytes(w.data, w.starts[first[same]], self.bytes, self.said[at[same]], size[same])
        odd = np.flatnonzero(other)
        if len(odd):
            own, n = self._encode(w, first[odd])
            begin[odd], count[odd] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate([ids, own])
        count = count[back]
        ids = ids[tc.ragged(begin[back], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[w.docs]


@lru_cache(maxsize=2)
def tokenizer(definition: str) -> WordTokenizer:
    return WordTokenizer(definition)


@lru_cache(maxsize=4)
def patterns(bins: int) -> np.ndarray:
    """All combinations of up to three lengths that add up to `bins`, as (combinations, 3), 0 for none."""
    a, b = np.meshgrid(np.arange(bins + 1), np.arange(bins + 1), indexing="ij")
    c = bins - a - b
    keep = (a >= b) & (b >= c) & (c >= 0) & (a > 0)
    return np.stack([a[keep], b[keep], c[keep]], 1)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active set method of Lawson and Hanson.

    Should it not settle in three rounds for each unknown, it warns and gives
    the x so far, which is still feasible.
    """
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * n):
        slope = target - gram @ x
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        free[best] = True
        while True:
            own = np.flatnonzero(free)
            want = np.linalg.lstsq(gram[np.ix_(own, own)], target[own], rcond=None)[0]
            if (want > 0).all():
                x[:] = 0
                x[own] = want
                break
            low = want <= 0
            step = np.min(x[own][low] / np.maximum(x[own][low] - want[low], 1e-300))
            x[own] += step * (want - x[own])
            free[own[low & (x[own] <= 1e-12)]] = False
            x[~free] = 0
            if not free.any():
                break
    else:
        warnings.warn("nnls did not settle", RuntimeWarning, stacklevel=2)
    return x


def combine(sizes: np.ndarray, length: int, grain: int) -> tuple[list[list[int]], list[int]]:
    """Pieces (indices into sizes) that share a window each, and the residual pieces."""
    bins = length // grain
    # Sizes above the last whole bin, where `grain` doesn't divide `length`, are residual.
    kind = np.minimum(-(-sizes // grain), bins + 1)
    have = np.bincount(kind, minlength=bins + 2)
    shapes = patterns(bins)
    matrix = np.zeros((bins + 1, len(shapes)))
    for k in range(3):
        np.add.at(matrix, (shapes[:, k], np.arange(len(shapes))), 1)
    matrix[0] = 0
    possible = (matrix <= have[:-1, None]).all(0)
    shapes, matrix = shapes[possible], matrix[:, possible]
    want = np.floor(nnls(matrix, have[:-1].astype(float)) + 1e-9).astype(int) if len(shapes) else np.empty(0, int)
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(have)
    nxt, stop = (ends - have).tolist(), ends.tolist()
    windows: list[list[int]] = []
    for s in np.argsort(-want, kind="stable").tolist():
        if want[s] <= 0:
            break
        parts = [p for p in shapes[s].tolist() if p]
        for _ in range(int(want[s])):
            need = {p: parts.count(p) for p in parts}
            if any(stop[p] - nxt[p] < n for p, n in need.items()):
                break
            window = []
            for p in parts:
                window.append(int(order[nxt[p]]))
                nxt[p] += 1
            windows.append(window)
    rest = [int(i) for p in range(bins + 1, 0, -1) for i in order[nxt[p] : stop[p]]]
    spare = int(sizes[rest].sum()) if rest else 0
    slack = [length - int(sizes[x].sum()) for x in windows]
    total = sum(slack)
    while windows and total > spare:
        x = windows.pop()
        total -= slack.pop()
        spare += int(sizes[x].sum())
        rest += x
    return windows, rest


def pack(sizes: np.ndarray, length: int = LENGTH, grain: int = GRAIN) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of the given sizes."""
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    whole = sizes // length
    for d in np.flatnonzero(whole).tolist():
        for k in range(int(whole[d])):
            out.append((d, k * length, length, seq, 0))
            seq += 1
    left = sizes - whole * length
    docs = np.flatnonzero(left)
    size, begin = left[docs], (whole * length)[docs]
    windows, rest = combine(size, length, grain)
    stream = [(int(docs[i]), int(begin[i]), int(size[i])) for i in rest]
    at, used = 0, 0

    def lay(room: int, offset: int) -> None:
        nonlocal at, used
        while room and at < len(stream):
            d, s, n = stream[at]
            take = min(room, n - used)
            out.append((d, s + used, take, seq, offset))
            room, offset, used = room - take, offset + take, used + take
            if used == n:
                at, used = at + 1, 0

    for x in windows:
        offset = 0
        for i in x:
            out.append((int(docs[i]), int(begin[i]), int(size[i]), seq, offset))
            offset += int(size[i])
        lay(length - offset, offset)
        seq += 1
    remaining = sum(n for _, _, n in stream[at:]) - used
    while remaining:
        room = length if remaining >= length else 1 << (remaining.bit_length() - 1)
        lay(room, 0)
        remaining -= room
        seq += 1
    return out


def _packed(batches: Iterator[pa.RecordBatch], definition: Broadcast, length: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = tokenizer(definition.value)
    serial = TaskContext.get().partitionId() << 33
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    tokens = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal serial, tokens
        names = pa.concat_arrays([h[0] for h in held])
        ids = np.concatenate([h[1] for h in held]).astype("<u4")
        sizes = np.concatenate([h[2] for h in held])
        held.clear()
        tokens = 0
        begin = np.cumsum(sizes) - sizes
        pieces = np.array(pack(sizes, length), np.int64).reshape(-1, 5)
        raw = memoryview(ids).cast("B")
        lo = (begin[pieces[:, 0]] + pieces[:, 1]) * 4
        hi = lo + pieces[:, 2] * 4
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        columns = [
            names.take(pa.array(pieces[:, 0])),
            pa.array(pieces[:, 1]),
            pa.array(pieces[:, 2]),
            pa.array(crc, pa.int64()),
            pa.array(sizes[pieces[:, 0]]),
            pa.array(pieces[:, 3] + serial),
            pa.array(pieces[:, 4]),
        ]
        table = pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        upto = np.concatenate([[0], np.cumsum(pieces[:, 2])])
        a = 0
        while a < len(pieces):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + SEND_TOKENS, "right")) - 1)
            part = table.slice(a, b - a)
            if with_ids:
                own = pa.array(ids[tc.ragged(lo[a:b] // 4, pieces[a:b, 2])].view(np.int32))
                part = part.append_column("ids", pa.ListArray.from_arrays(pa.array((upto[a : b + 1] - upto[a]).astype(np.int32)), own))
            yield part
            a = b
        serial += int(pieces[:, 3].max()) + 1

    for batch in tc.chunks(batches):
        ids, at = encoder.encode(batch.column("text"))
        size = np.diff(at) + 1
        # Every text is followed by the end id.
        out = np.full(len(ids) + batch.num_rows, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(batch.num_rows), size - 1)] = ids
        held.append((batch.column("doc_id"), out, size))
        tokens += len(out)
        if tokens >= UNIT_TOKENS:
            yield from flush()
    if held:
        yield from flush()
    encoder.clear()
    tc.trim()


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack all texts of docs (doc_id, text) into sequences of at most `length` tokens.

    Returns a row for each piece: doc_id, start (the document's ids before
    it), length, ids_crc32 (of its ids as little-endian unsigned 32-bit
    numbers), doc_tokens (ids of the document, the end id included),
    sequence_id, offset in the sequence and, with_ids, ids. Each id of a
    document is in exactly one piece; the pieces of a sequence lie without
    gaps from 0 and fill it: it has `length` ids, or a power of two.

    Null and empty texts are the end id alone. Null ids and repeated rows are
    documents of their own. Other columns are not read; an empty table gives
    no rows. sequence_id is unique, not consecutive: its upper bits are the
    partition's number.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_packed, definition=definition, length=length, end_id=end_id, with_ids=with_ids),
        schema + ", ids array<int>" * with_ids,
    )
