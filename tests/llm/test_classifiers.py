"""The classifiers' searches and votes against plain versions, their samples and calibration."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from minewright.llm import quality, toxicity
from minewright.llm import textcodes as tc
from minewright.llm.labelled import fold, sample

SF = "/root/testdata/sf0.01"


def tables(spark):
    return (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))


def ranked(cosines, k):
    """Places of the k greatest, by value to 12 places, then by place."""
    return sorted(range(len(cosines)), key=lambda i: (-round(cosines[i], 12), i))[:k]


@pytest.mark.parametrize(("n", "block", "k"), [(500, 64, 15), (1000, 8, 15), (20, 64, 15), (300, 16, 1)])
def test_block_max_search_equals_a_dense_product(monkeypatch, n, block, k):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(n)
    terms = 30
    # Few terms and few weights, so that many cosines are equal.
    dense = (rng.random((n, terms)) < 0.1) * rng.integers(1, 3, (n, terms))
    dense = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    row, column = np.nonzero(dense)
    cuts = np.searchsorted(row, np.arange(n + 1))
    index = toxicity.BlockMaxIndex(np.arange(n), rng.integers(0, 2, n), cuts, column, dense[row, column], terms)
    placed = dense[np.argsort(index.rank)]
    for q in (rng.random((60, terms)) < 0.12) * rng.integers(1, 3, (60, terms)):
        own = np.flatnonzero(q)
        if not len(own):
            continue
        weights = q[own] / np.linalg.norm(q[own])
        cosines = placed[:, own] @ weights
        for but in (-1, 5):
            want = [i for i in ranked(np.where(np.arange(n) == but, -1, cosines), k) if cosines[i] > 0 and i != but]
            place, cosine = index.nearest(own, weights, k, but=but)
            assert place.tolist() == want and cosine == pytest.approx(cosines[want])


def test_toxicity_scores_equal_plain_votes(spark):
    docs, labels = tables(spark)
    model = toxicity.train(docs.select("doc_id", "text"), labels, fold("doc_id", 3, 1))
    n, terms = len(model.index.ids), len(model.vocabulary)
    dense = np.zeros((n, terms))
    at = np.searchsorted(model.index.begin, np.arange(len(model.index.doc)), "right") - 1
    dense[model.index.doc, at // model.index.blocks] = model.index.weight
    texts = pa.array(pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:300] + [None, "", "..."])
    cuts, columns, weights = model.vocabulary.vectors(texts, toxicity.extract)
    scores, evidence = model.score(texts)
    for d in range(len(texts)):
        own = slice(cuts[d], cuts[d + 1])
        cosines = dense[:, columns[own]] @ weights[own]
        near = [i for i in ranked(cosines, toxicity.NEIGHBOURS) if cosines[i] > 0]
        votes = [(cosines[i] * model.weight[model.index.labels[i]], model.index.labels[i]) for i in near]
        p = (sum(v for v, y in votes if y) + 0.5 * model.share) / (sum(v for v, _ in votes) + 0.5)
        p = min(max(p, 1e-3), 1 - 1e-3)
        a, b = model.curve
        assert scores[d] == pytest.approx(1 / (1 + math.exp(-(a * math.log(p / (1 - p)) + b))))
        assert evidence[d] == model.index.ids[near].tolist()


def test_known_terms_are_those_of_all_terms():
    texts = pa.array(["Kind words, kinder word kindest!", None, "", "kin kin KIN", "été 漢字漢字 x", "abcdefghijkl abcdefghi"])
    for extract in (toxicity.extract, quality.extract):
        doc, term, tf = extract(texts, None)
        known = np.unique(term)[::2]
        own = np.isin(term, known)
        assert all((a == b).all() for a, b in zip(extract(texts, known), (doc[own], term[own], tf[own]), strict=True))


def test_calibration_follows_the_examples():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, 20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-(1.7 * x - 0.8)))).astype(float)
    assert toxicity.logistic(x, y, np.ones(20000)) == pytest.approx((1.7, -0.8), abs=0.1)
    assert toxicity.logistic(np.zeros(0), np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def test_quality_scores_equal_plain_votes(spark):
    docs, labels = tables(spark)
    model = quality.train(docs.select("doc_id", "text"), labels, fold("doc_id", 4, 2))
    texts = pa.array(pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:200] + [None, ""])
    scores = model.score(texts)
    cuts, columns, weights = model.vocabulary.vectors(texts, quality.extract)
    for d in range(len(texts)):
        z = sum((w * model.axes[c] for c, w in zip(columns[cuts[d] : cuts[d + 1]], weights[cuts[d] : cuts[d + 1]], strict=True)), np.zeros(model.axes.shape[1]))
        z = z / max(np.linalg.norm(z), 1e-12)
        cosines = [float(np.dot(z, e)) for e in model.examples]
        votes = [(max(cosines[i], 0) ** 2 * model.weight[i], model.y[i]) for i in ranked(cosines, quality.NEIGHBOURS)]
        want = (sum(v * y for v, y in votes) + 1e-3 * model.share) / (sum(v for v, _ in votes) + 1e-3)
        assert scores[d] == pytest.approx(want, abs=1e-6)


def test_ties_at_the_last_neighbour_go_to_the_first():
    cosine = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2], [0.1, 0.2, 0.3, 0.4, 0.5]])
    assert [sorted(x) for x in quality.nearest(cosine, 2).tolist()] == [[0, 1], [0, 1], [3, 4]]


def test_a_sample_holds_one_row_of_an_id(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(1, None), (2, None), (3, "a"), (3, "a"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1), (9, 1), (4, None)], "doc_id long, toxic int")
    got, shares = sample(docs, labels, "toxic", fold("doc_id", 3, 7), 10)
    found = {r.doc_id: (r.y, r.text) for r in got.collect()}
    assert got.count() == 3 and found[1][0] == 1 and found[1][1] is not None and found[2] == (0, None) and found[3] == (0, "a")
    assert shares == {1: 0.5, 0: 0.5}
    few, _ = sample(docs, labels, "toxic", fold("doc_id", 3, 7), 1)
    assert few.count() <= 2


def test_every_text_scores_half_without_labels(spark):
    docs, labels = tables(spark)
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert {r.score for r in score(docs, labels.where("false")).collect()} == {0.5}


def test_equal_texts_score_alike(spark):
    docs, labels = tables(spark)
    some = docs.where("doc_id < 50").select("doc_id", "text")
    twice = docs.unionByName(docs.where("doc_id < 50").selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars"))
    for score in (quality.score_quality, toxicity.score_toxicity):
        got = {r.doc_id: r.score for r in score(twice, labels).collect()}
        assert all(got[r.doc_id] == pytest.approx(got[r.doc_id + 1000000], abs=1e-9) for r in some.collect())


def test_words_of_a_byte_view_end_with_the_data():
    w = tc.words(pa.array(["abc", "de"]))
    assert tc.blocks(w.data)[w.starts].tolist() == [int.from_bytes(b"abcde", "little"), int.from_bytes(b"de", "little")]
