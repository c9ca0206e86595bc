"""Words and hashes of Arrow text columns, computed on whole byte buffers.

Texts are never split into Python strings: word borders come from a table
over byte values. A word's hash chains a bijective scrambling over its bytes,
eight at a time, and the hash of a run of words joins those of its two halves,
level by level (as in naming by doubling). Neither is linear, so regular texts
don't cancel out, and the same words give the same hash in every task. Each
exists for two seeds that share nothing. Where even a chance collision must not
matter, `Words.distinct` tells words apart by their bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
#: Bytes of a word up to which it is hashed side by side with others.
WIDE = 64
SALT = np.uint64(0x589965CC75374CC3)
_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_LEFT = np.uint64(0xA0761D6478BD642F)
_RIGHT = np.uint64(0xE7037ED1A0B428DB)
#: For 0 to 8 bytes, those bits of a block that they fill.
_FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word between white space: everything but 0x20 and 0x09-0x0D.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of a word once A-Z are lower case: digits, a-z and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash from those of two runs of words; the order counts."""
    x = a * _LEFT
    x ^= x >> np.uint64(32)
    x += b
    x *= _RIGHT
    x ^= x >> np.uint64(29)
    return x


def blocks(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the seven behind it as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def equal_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size[i] bytes of a from at[i] on are those of b from bt[i] on."""
    out = np.ones(len(size), bool)
    one, two = blocks(a), blocks(b)
    live = np.flatnonzero(size > 0)
    for k in range(0, WIDE, 8):
        if not len(live):
            return out
        own = _FILLED[np.minimum(size[live] - k, 8)]
        out[live] &= (one[at[live] + k] ^ two[bt[live] + k]) & own == 0
        live = live[(size[live] > k + 8) & out[live]]
    for i in live.tolist():
        out[i] = np.array_equal(a[at[i] : at[i] + size[i]], b[bt[i] : bt[i] + size[i]])
    return out


class Words:
    """The words of a run of texts.

    data: bytes (lower case if asked for); starts, ends: byte span of each
    word; docs: for each text the number of its first word, and the total;
    bounds: the same for bytes.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, word_bytes: np.ndarray, lower: bool, cut: tuple[np.ndarray, np.ndarray] | None = None):
        self.data = LOWER[data] if lower else data
        self.bounds = bounds
        inside = word_bytes[self.data]
        n = len(inside)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = bounds[:-1][bounds[:-1] < n]
        first[at] = inside[at]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = bounds[1:][bounds[1:] > 0] - 1
        last[at] = inside[at]
        if cut is not None:
            part = inside[:-1] & cut[0][self.data[:-1]] & inside[1:] & cut[1][self.data[1:]]
            first[1:] |= part
            last[:-1] |= part
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.docs = np.searchsorted(self.starts, bounds)
        self._hashes: dict[int, np.ndarray] = {}

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    @property
    def sizes(self) -> np.ndarray:
        """Bytes of each word."""
        return self.ends - self.starts

    @property
    def doc_of(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.docs) - 1), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.hash(0)

    def hash(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word's bytes, one for each seed."""
        kept = self._hashes.get(seed)
        if kept is not None:
            return kept
        size = self.sizes
        first = np.uint64(_SEEDS[seed])
        block = blocks(self.data)
        out = mix((block[self.starts] & _FILLED[np.minimum(size, 8)]) ^ first * size.astype(np.uint64))
        live = np.flatnonzero((size > 8) & (size <= WIDE))
        for k in range(8, WIDE, 8):
            if not len(live):
                break
            more = block[self.starts[live] + k] & _FILLED[np.minimum(size[live] - k, 8)]
            out[live] = mix(out[live] * _STEP ^ more ^ first)
            live = live[size[live] > k + 8]
        for i in np.flatnonzero(size > WIDE).tolist():
            said = hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8, person=b"words%d" % seed)
            out[i] = int.from_bytes(said.digest(), "little")
        self._hashes[seed] = out
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """A first place of each different word, and for each word the number of its kind, told apart by bytes."""
        _, first, back = np.unique(self.hashes, return_index=True, return_inverse=True)
        size, like = self.sizes, first[back]
        same = size == size[like]
        at = np.flatnonzero(same & (like != np.arange(len(like))))
        same[at] = equal_bytes(self.data, self.starts[at], self.data, self.starts[like[at]], size[at])
        odd: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(~same).tolist():
            said = self.data[self.starts[i] : self.ends[i]].tobytes()
            if said not in odd:
                odd[said] = len(first) + len(more)
                more.append(i)
            back[i] = odd[said]
        return np.concatenate([first, np.array(more, first.dtype)]), back

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each position on; those at which fewer are left are absent."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        level, have = self.hash(seed), 1
        while 2 * have <= k:
            level, have = join(level[:-have], level[have:]), 2 * have
        if have < k:
            level = join(level[:n], level[k - have : k - have + n])
        return mix(level[:n] + np.uint64(k))

    def spans(self, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hash of the words from start to stop of each given span; that of k words equals their gram's."""
        n = stop - start
        out = np.zeros(len(start), np.uint64)
        level, have = self.hash(seed), 1
        while len(n) and have <= n.max():
            own = np.flatnonzero((n >= have) & (n < 2 * have))
            a = level[start[own]]
            long = n[own] > have
            out[own] = np.where(long, join(a, level[stop[own] - have]), a)
            if 2 * have > len(self.starts):
                break
            level, have = join(level[:-have], level[have:]), 2 * have
        return mix(out + n.astype(np.uint64))

    def runs(self, at: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
        """The grams of k words at a few places only."""
        out = np.empty(len(at), np.uint64)
        own = self.hash(seed)
        for lo in range(0, len(at), 1 << 16):
            level, have = own[at[lo : lo + (1 << 16), None] + np.arange(k)], 1
            while 2 * have <= k:
                level, have = join(level[:, :-have], level[:, have:]), 2 * have
            if have < k:
                level = join(level[:, :1], level[:, k - have : k - have + 1])
            out[lo : lo + (1 << 16)] = level[:, 0]
        return mix(out + np.uint64(k))

    def inside(self, k: int) -> np.ndarray:
        """Positions at which k words of one text begin."""
        room = np.repeat(self.docs[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(room >= k)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text array and where each text begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    n = len(texts)
    if n == 0 or at is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about limit bytes in the given text columns; a longer row stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bounds = sum(text_bytes(batch.column(c))[1] for c in columns or ("text",))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    trim()


def words(texts: pa.Array, word_bytes: np.ndarray = NON_SPACE, lower: bool = False, cut: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """The words of texts; cut: byte tables (left, right), where words part between such bytes too."""
    data, bounds = text_bytes(texts)
    return Words(data, bounds, word_bytes, lower, cut)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] values each, one after another."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def trim() -> None:
    """Give memory that is no longer used back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
