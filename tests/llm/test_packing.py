"""Packing of odd inputs, whole round trips, and its least squares."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from minewright.llm import packing
from minewright.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = [None, "", "  \t\n", "one", "one", "Ünïcode 漢字 😀\x00", "word " * 30000, "x" * 20000, "a-b.c'd 12345", " lead and trail "]


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("length", [16, 100, 4096])
def test_every_id_of_odd_texts_is_in_one_piece(spark, length):
    rows = [*enumerate(TEXTS), (3, "one"), (None, "no id"), (None, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"start": F.lit("clash"), "ids": F.lit(0)})
    got = packing.pack_documents(given, PATH, length=length, with_ids=True).toPandas()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        ends = (s["offset"] + s["length"]).tolist()
        assert s["offset"].tolist() == [0, *ends[:-1]]
        assert ends[-1] == length or (ends[-1] < length and ends[-1] & (ends[-1] - 1) == 0)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got.itertuples())
    # Documents that share an id, or have none, are told apart by their sizes and ids alone.
    want = sorted(i for _, t in rows for i in ids_of(t))
    assert sorted(i for ids in got.ids for i in ids) == want
    for d, text in enumerate(TEXTS):
        if d != 3:
            own = got[got.doc_id == d].sort_values("start")
            assert [i for ids in own.ids for i in ids] == ids_of(text) and (own.doc_tokens == len(ids_of(text))).all()
    assert packing.pack_documents(given.where("false"), PATH).count() == 0


def test_batches_of_pieces_lose_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(1)
    whole = packing.pack_documents(docs, PATH, with_ids=True).toPandas()
    assert whole.groupby("doc_id").length.sum().to_dict() == whole.groupby("doc_id").doc_tokens.first().to_dict()
    assert (whole.ids.map(len) == whole.length).all()
    short = whole.groupby("sequence_id").length.sum()
    assert (short < 4096).sum() <= 12


def test_least_squares_are_least():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 8)), rng.random(12)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-8).all() and np.abs(slope[x > 0]).max(initial=0) <= 1e-8


def test_combinations_fill_windows():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 4096, 3000)
    windows, rest = packing.combine(sizes, 4096, 32)
    used = sorted(i for w in windows for i in w) + sorted(rest)
    assert sorted(used) == list(range(3000)) and len(windows) > 500
    assert all(int(sizes[w].sum()) <= 4096 and len(w) <= 3 for w in windows)
    pieces = packing.pack(sizes)
    assert sum(p[2] for p in pieces) == sizes.sum()


def test_ids_of_words_with_marks_are_the_tokenizers():
    rng = np.random.default_rng(6)
    bits = ["<|endoftext|>", "<|startoftext|>", "endoftext|>", "|", "||", "'s", "'", "don't", "x", "Word", "7", "12", ".", ",", "$$$", "=", "\u0338", "H\u0331", "é", "É", "\u0301", "漢", "😀", " ", "\n", "\u00a0", "\x00", "#", "\u037e", "İ", "Σ"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(4000)]
    encoder = packing.WordTokenizer(open(PATH, encoding="utf-8").read())
    assert encoder.cut is not None
    ids, at = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of_plain(encoder, text), repr(text)


def ids_of_plain(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids
