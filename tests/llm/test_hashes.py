"""Words and windows that defeat a polynomial hash, and words whose hashes are made equal."""

import numpy as np
import pyarrow as pa
import pytest

from minewright.llm import decontaminate, minhash_dedup, packing, substring_dedup, token_counts
from minewright.llm import textcodes as tc
from minewright.llm.queries import vocabulary


def thue_morse(n, a="a", b="b"):
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out


def pair(n, a="a", b="b"):
    one = thue_morse(n, a, b)
    return one, [b if x == a else a for x in one]


WORDS = ["".join(x) for n in (1024, 4096) for x in pair(n)]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_thue_morse_words_have_their_own_hashes():
    w = tc.words(pa.array([" ".join(WORDS + ["short", "short"])]))
    for seed in (0, 1):
        assert len(set(w.hash(seed).tolist())) == len(WORDS) + 1
    assert not set(w.hash(0).tolist()) & set(w.hash(1).tolist())


def test_thue_morse_windows_have_their_own_hashes():
    for n in (32, 64, 1024):
        one, two = (tc.words(pa.array([" ".join(x)])) for x in pair(n))
        for seed in (0, 1):
            assert one.grams(n, seed)[0] != two.grams(n, seed)[0]
            assert one.grams(n, seed)[0] == one.spans(np.array([0]), np.array([n]), seed)[0] == one.runs(np.array([0]), n, seed)[0]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 10, 25, 50])
def test_grams_spans_and_runs_agree(k):
    rng = np.random.default_rng(k)
    w = tc.words(pa.array([" ".join(map(str, rng.integers(0, 3, 300)))]))
    at = np.arange(300 - k + 1)
    by_words = {}
    for i in at.tolist():
        raw = w.data[w.starts[i] : w.ends[i + k - 1]].tobytes()
        by_words.setdefault(raw, set()).add(int(w.grams(k)[i]))
    assert all(len(x) == 1 for x in by_words.values()) and len({h for x in by_words.values() for h in x}) == len(by_words)
    assert (w.grams(k) == w.spans(at, at + k)).all() and (w.grams(k) == w.runs(at, k)).all()


def test_token_counts_and_ids(spark):
    given = docs(spark, [" ".join(WORDS), *WORDS])
    model = token_counts.Automaton(token_counts.read_vocabulary(vocabulary("piece_bpe_32k.model")))
    each = [model.count_one(x.encode()) for x in WORDS]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(given, vocabulary("piece_bpe_32k.model")).collect()}
    assert got == dict(enumerate([sum(each), *each]))
    same_ids([" ".join(WORDS), *WORDS])


def same_ids(texts):
    path = vocabulary("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        encoder = packing.WordTokenizer(f.read())
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts))
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_words_are_told_apart_by_bytes_when_hashes_collide(monkeypatch):
    monkeypatch.setattr(tc.Words, "hash", lambda self, seed: np.full(len(self.starts), 7, np.uint64))
    said = ["one", "two", "one", "a much longer word", "x" * 200, "x" * 199 + "y", "x" * 200, "", "é"]
    w = tc.words(pa.array(said))
    texts = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    first, back = w.distinct()
    assert [texts[i] for i in first[back]] == texts and len(first) == len(set(texts))
    same_ids(said)


def test_substring_dedup(spark):
    fill = [f"w{i}" for i in range(49)]
    for n in (0, 2):
        a, b = WORDS[n], WORDS[n + 1]
        got = substring_dedup.remove_repeats(docs(spark, [" ".join([a, *fill]), " ".join([b, *fill]), " ".join([a, *fill])])).collect()
        assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 0, 2: 50}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_decontamination(spark, limit):
    fill = [f"w{i}" for i in range(9)]
    bench = spark.createDataFrame([(n, " ".join([WORDS[n], *fill])) for n in (0, 2)], "item_id long, text string")
    got = decontaminate.contamination(docs(spark, [" ".join([x, *fill]) for x in WORDS]), bench, broadcast_chars=limit).collect()
    assert {r.doc_id: r.n_hit for r in got} == {0: 10, 1: 0, 2: 10, 3: 0}


def test_near_duplicates(spark):
    texts = [" ".join([x, "s", "t"]) for x in WORDS]
    got = minhash_dedup.near_duplicates(docs(spark, [*texts, texts[0]]), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
