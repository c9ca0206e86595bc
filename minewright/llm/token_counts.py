"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenization takes the longest vocabulary piece at each
position. A trie of the pieces' bytes with failure links does so in one pass:
a node's failure link leads to the node that is reached once the greedy pieces
of its string are popped, and how many those are is computed beforehand, as is
the number that a node's string gives at the end of a word. Counting adds
these numbers and never builds a piece.

All single bytes are pieces, so that every word has a tokenization. The
automaton steps through the different words of a batch side by side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm import textcodes as tc
from minewright.runtime import ship_package

#: Bytes of a word up to which it is counted side by side with others.
WIDE = 64


class Automaton:
    """Trie with failure links over pieces of bytes; `start` stands before each word."""

    def __init__(self, pieces: Iterable[bytes], start: bytes = "\u2581".encode()):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            node = 0
            for b in piece:
                step = children[node].get(b)
                if step is None:
                    step = children[node][b] = len(children)
                    children.append({})
                    final.append(False)
                node = step
            final[node] = node != 0
        fail, pops, parent_first = [-1] * len(children), [0] * len(children), [0]
        for node in parent_first:
            for b, child in children[node].items():
                parent_first.append(child)
                if final[child]:
                    fail[child], pops[child] = 0, 1
                    continue
                # Not a piece: pop the parent's pieces, then follow b from where that leads.
                z, n = fail[node], pops[node]
                while z >= 0 and b not in children[z]:
                    n += pops[z]
                    z = fail[z]
                fail[child], pops[child] = (children[z][b], n) if z >= 0 else (-1, 0)
        self.children, self.fail, self.pops = children, np.array(fail), np.array(pops)
        self.ends = np.zeros(len(children), np.int64)
        for node in parent_first[1:]:
            self.ends[node] = self.pops[node] + self.ends[self.fail[node]]
        keys = np.array(sorted((node << 8 | b, child) for node, c in enumerate(children) for b, child in c.items()), np.int64)
        self.keys, self.target = keys[:, 0].copy(), keys[:, 1].copy()
        self.start, self.popped = 0, 0
        for b in start:
            self.start, n = self._step(self.start, b)
            self.popped += n

    def _step(self, node: int, b: int) -> tuple[int, int]:
        n = 0
        while b not in self.children[node]:
            n += int(self.pops[node])
            node = int(self.fail[node])
        return self.children[node][b], n

    def count_one(self, word: bytes) -> int:
        """Pieces of one word, byte by byte."""
        children, fail, pops = self.children, self.fail, self.pops
        node, n = self.start, self.popped
        for b in word:
            while b not in children[node]:
                n += int(pops[node])
                node = int(fail[node])
            node = children[node][b]
        return n + int(self.ends[node])

    def count(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pieces of each word, given by its place in data."""
        out = np.zeros(len(starts), np.int64)
        for i in np.flatnonzero(sizes > WIDE).tolist():
            out[i] = self.count_one(data[starts[i] : starts[i] + sizes[i]].tobytes())
        own = np.flatnonzero(sizes <= WIDE)
        own = own[np.argsort(-sizes[own], kind="stable")]
        begin, size = starts[own], sizes[own]
        node, n = np.full(len(own), self.start), np.full(len(own), self.popped)
        for k in range(int(size.max(initial=0))):
            live = np.arange(int(np.searchsorted(-size, -k)))
            b = data[begin[live] + k].astype(np.int64)
            while len(live):
                key = node[live] << 8 | b
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = self.keys[at] == key
                node[live[there]] = self.target[at[there]]
                live, b = live[~there], b[~there]
                n[live] += self.pops[node[live]]
                node[live] = self.fail[node[live]]
        out[own] = n + self.ends[node]
        return out


@lru_cache(maxsize=2)
def _automaton(pieces: tuple[bytes, ...]) -> Automaton:
    return Automaton(pieces)


def _counts(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(vocabulary.value)
    for batch in tc.chunks(batches):
        w = tc.words(batch.column("text"))
        first, back = w.distinct()
        tokens = automaton.count(w.data, w.starts[first], w.sizes[first])[back]
        total = np.concatenate([[0], np.cumsum(tokens)])[w.docs]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(np.diff(w.bounds)), pa.array(np.diff(total))],
            ["doc_id", "n_words", "n_bytes", "n_tokens"],
        )


def read_vocabulary(path: str) -> tuple[bytes, ...]:
    """The ordinary pieces of a sentencepiece model file; the word start is the mark U+2581."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return tuple(model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not special(i))


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Greedy longest-match word-piece counts of each text of docs (doc_id, text).

    Words are runs of characters other than white space (0x20, 0x09-0x0D),
    preceded by the mark U+2581; bytes that begin no piece count as one token each.
    Returns for each row doc_id, n_words, n_bytes (UTF-8) and n_tokens. Null
    and empty texts have zeros. Null ids and repeated rows stay as they are.
    Other columns are not read; an empty table gives no rows. No shuffle; the
    vocabulary, of fixed size, is broadcast.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_counts, vocabulary=vocabulary), "doc_id long, n_words long, n_bytes long, n_tokens long"
    )
