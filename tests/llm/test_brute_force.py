"""Whole queries against brute-force versions that share no code with the operators."""

import hashlib
import math
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from minewright.llm import decontaminate, embedding_dedup, pii, quality, queries, token_counts, toxicity
from minewright.llm import textcodes as tc
from minewright.llm.queries import vocabulary

SF = os.environ.get("BRUTE_SF_DIR", "/root/testdata/sf0.001")


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# token counts

def greedy(word, pieces, longest):
    n = 0
    while word:
        for k in range(min(longest, len(word)), 0, -1):
            if word[:k] in pieces or k == 1:
                word, n = word[k:], n + 1
                break
    return n


def brute_tokens(text, pieces, longest):
    return sum(greedy(("▁" + w).encode(), pieces, longest) for w in re.findall("[^\x20\x09-\x0d]+", text or ""))


def test_token_counts(spark):
    pieces = set(token_counts.read_vocabulary(vocabulary("piece_bpe_32k.model")))
    longest = max(map(len, pieces))
    want = {r.doc_id: brute_tokens(r.text, pieces, longest) for r in read("documents").itertuples()}
    assert {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, SF).collect()} == want


def test_token_counts_of_odd_texts(spark):
    texts = [None, "", " \t\n", "x" * 5000, "▁▁ ▁a", "漢字 été 😀", "a b", "the the the", "the the the"]
    pieces = set(token_counts.read_vocabulary(vocabulary("piece_bpe_32k.model")))
    longest = max(map(len, pieces))
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = token_counts.count_tokens(given, vocabulary("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: brute_tokens(t, pieces, longest) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(given.where("false"), vocabulary("piece_bpe_32k.model")).count() == 0


# packing

def test_packed_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    docs = read("documents").set_index("doc_id")
    got = queries.op4_packing(spark, SF).toPandas()
    assert set(got.doc_id) == set(docs.index)
    assert not got.duplicated(["sequence_id", "offset"]).any()
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in docs.text.items()}
    for r in got.itertuples():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert got.length.sum() == sum(map(len, ids.values()))


# decontamination

def brute_contamination(texts, items, span=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in items:
        w = word.findall(lower(t))
        for a in range(max(1, len(w) - span + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + span]), set()).add(i)
    lengths = sorted({len(x) for x in windows})
    out = {}
    for d, t in texts:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                own = windows.get(tuple(w[a : a + n]))
                if own:
                    found |= own
                    hit.update(range(a, a + n))
        said = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(said.encode()).hexdigest(), bool(hit))
    return out


def contaminated_rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_decontamination(spark):
    want = brute_contamination(read("documents")[["doc_id", "text"]].itertuples(index=False), read("benchmark")[["item_id", "text"]].itertuples(index=False))
    assert contaminated_rows(queries.op5_decontamination(spark, SF)) == want


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_decontamination_of_odd_texts(spark, limit):
    words = [f"w{i}" for i in range(30)]
    texts = [None, "", "...", " ".join(words), " ".join(words[5:15]), " ".join(words[:9]), "Short ITEM", "a short item b short item", "été 漢字", "w1", "x " * 3000 + " ".join(words[:10])]
    items = [(1, " ".join(words[:12])), (2, None), (3, ""), (4, "short item"), (5, "SHORT-item"), (10, "w1"), (7, "été"), (7, "漢字"), (8, " ".join(["x"] * 12))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = decontaminate.digest(decontaminate.contamination(docs, bench, broadcast_chars=limit))
    want = brute_contamination(enumerate(texts), items)
    assert contaminated_rows(got) == want
    kept = decontaminate.drop_contaminated(docs, bench, broadcast_chars=limit)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, x in want.items() if not x[4]}
    none = decontaminate.contamination(docs, bench.where("false"), broadcast_chars=limit)
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(texts)
    assert decontaminate.contamination(docs.where("false"), bench, broadcast_chars=limit).count() == 0


# embeddings

def brute_links(ids, vectors, cosine=0.9):
    usable = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    x = np.stack([np.array(vectors[i], float) / np.abs(np.array(vectors[i], float)).max() for i in usable])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    return usable, near


def components(ids, usable, near):
    root = {i: i for i in ids}
    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i, j in np.argwhere(near):
        a, b = find(ids[usable[i]]), find(ids[usable[j]])
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_embeddings(spark):
    rows = read("embeddings")
    ids = rows.vec_id.tolist()
    usable, near = brute_links(ids, rows.embedding.tolist())
    links = dict.fromkeys(ids, 0) | {ids[u]: int(n) for u, n in zip(usable, near.sum(1), strict=True)}
    want = {i: (links[i], c) for i, c in components(ids, usable, near).items()}
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op7_embedding_dedup(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(links.values())
    assert sum(got[i] != want[i] for i in ids) <= 0.03 * len(ids)


def test_embeddings_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16).tolist()
    rows = [(0, base), (1, base), (2, [2 * x for x in base]), (3, None), (4, []), (5, [0.0] * 16), (6, [float("nan")] * 16), (7, [None] + base[1:]), (8, [-x for x in base]), (9, base[:8]), (10, [float("inf")] + base[1:]), (11, [1e200 * x for x in base])]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(given).collect()}
    alike = {0, 1, 2, 11}
    assert got == {i: (3, 0, i == 0) if i in alike else (0, i, True) for i, _ in rows}
    assert embedding_dedup.near_vectors(given.where("false")).count() == 0


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, said):
    digits = re.sub("[^0-9]", "", said)
    if kind == "ip":
        return all(int(p) <= 255 for p in said.split("."))
    if kind == "card":
        double = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in double) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_base(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
    found.sort()
    count = tuple(sum(f[3] == k for f in found) for k in PATTERNS)
    return count, [f"{kind}:{s}:{e}" for s, _, e, kind in found]


def same_pii(rows, texts):
    for r in rows:
        count, spans = brute_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == count, texts[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("term:")] == spans


def test_pii(spark):
    texts = dict(read("documents")[["doc_id", "text"]].itertuples(index=False))
    rows = queries.op9_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    same_pii(rows, texts)


def test_pii_of_odd_texts(spark):
    texts = [None, "", "a@b.c d@e.f@g.h", "a@b a@b. x@y.z.", "@b.c .@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1.1 001.2.3.004", "4111 1111 1111 1111", "4111111111111111-2 4111-1111-1111-1111",
             "+1 (555) 123-4567, +12 ++49 30 1234567 +1 2 +123456789012345678", "😀 a@b.co 漢 +49 30 1234567", "1" * 3000, "٣@b.c 1.2.3.٤", "a" * 3000 + "@", "a@b.c-@d.e", "--@-.-"]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    rows = pii.sanitise(given).collect()
    assert len(rows) == len(texts)
    same_pii(rows, dict(enumerate(texts)))
    assert pii.sanitise(given.where("false")).count() == 0
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(given, with_text=True).collect()}
    assert clean[0] is None and clean[3] == "a@b a@b. [EMAIL]."


def test_disclosing_terms_are_found_either_way(spark):
    texts = [f"Note {i} foo{i} Zebulon owns zeb@corp.example item{i} bar{i}" for i in range(8)] + [f"plain words number {i}" for i in range(200)]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a = {r.doc_id: r.spans for r in pii.sanitise(given).collect()}
    b = {r.doc_id: r.spans for r in pii.sanitise(given, broadcast_rows=0).collect()}
    assert a == b and all("term:" in a[i] for i in range(8)) and all(a[i] == "" for i in range(8, 208))


def test_terms_beside_an_entity_named_once_are_found(spark):
    texts = ["the owner Zebulon has zeb@corp.example here"] + [f"the owner has plain words here {i % 50}" for i in range(199)]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (500_000, 0):
        got = {r.doc_id: r.sanitised for r in pii.sanitise(given, with_text=True, broadcast_rows=rows).collect()}
        assert got == dict(enumerate(["the owner [Name] has [EMAIL] here", *texts[1:]]))


def test_copies_keep_disclosing_terms(spark):
    texts = [f"Zebulon note{i} zeb@corp.example" for i in range(4)] * 100 + ["one Quimby has quim@corp.example"] * 300 + [f"plain words here {i}" for i in range(9300)]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (500_000, 0):
        got = {r.doc_id: r.spans for r in pii.sanitise(given, broadcast_rows=rows).collect()}
        assert all("term:0:7" in got[d] for d in range(400)) and all("term:4:10" in got[d] for d in range(400, 700))
        assert not any(got[d] for d in range(700, 10000))


def test_pairs_and_terms_are_counted_in_documents(spark):
    # zeb in 3 documents (one names it twice, one is a copy), "alpha" beside it in 2 and in 5 of all 40, "gone" in 1 of 1.
    texts = ["alpha zeb@c.example alpha zeb@c.example"] * 2 + ["zeb@c.example gone"] + ["alpha"] * 3 + ["x"] * 34
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.share for r in pii.disclosures(given, threshold=-9.0).collect())
    share = lambda n, df: math.log((n + 0.5 * 3 / 40) / (df + 0.5) * 40 / 3) / math.log(40 / 3)
    assert got == pytest.approx(sorted([share(2, 5), share(1, 1)]))


def test_contexts_have_six_words_however_far_off():
    word = lambda i: f"w{i}" + "長" * 150
    list_of = " , ".join(f"p{i}@c.example" for i in range(40))
    texts = [" ".join([*map(word, range(8)), "a@c.example", *map(word, range(8, 16))]), f"left one {list_of} right two", "x" + " " * 900 + "1.2.3.4" + "\n" * 900 + "y", "b@c.example", "", None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = {}
    for b in pii._contexts(iter([batch]), 6):
        for e, t, n in zip(*(b.column(c).to_pylist() for c in ("entity", "term", "n")), strict=True):
            assert n == 1
            if t:
                got.setdefault(e, set()).add(t)
    hashed = lambda words: set(tc.words(pa.array([" ".join(words)]), tc.ALNUM, lower=True).hashes.view(np.int64).tolist())
    key = lambda said, kind: pii.entity(said, (0, kind, len(said)))
    want = {key("a@c.example", 0): hashed(map(word, range(2, 14))), key("1.2.3.4", 1): hashed("xy")}
    want |= {key(f"p{i}@c.example", 0): hashed(["left", "one", "right", "two"]) for i in range(40)}
    assert got == want


def test_frequencies_are_summed_within_a_task():
    texts = ["a b a", "b", None, "", "c a"]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})] * 3
    hashed = tc.words(pa.array(["a b c"]), tc.ALNUM, lower=True).hashes
    wanted = type("Wanted", (), {"value": np.sort(hashed[:2])})
    rows = [r for b in pii._frequency(iter(batches), wanted) for r in zip(b.column("term").to_pylist(), b.column("df").to_pylist(), strict=True)]
    assert sorted(rows) == sorted(zip(hashed[:2].view(np.int64).tolist(), (6, 6), strict=True))


# classifiers

@pytest.mark.parametrize(("score", "label"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers(spark, score, label):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = score(docs, labels).toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    ranks = held.score.rank()
    one = held[label] == 1
    area = (ranks[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())
    assert area >= 0.85 and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x"), (3, "!!! ???"), (4, "word " * 20000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = score(odd, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in score(odd, labels.where("false")).collect()} <= {0.0, 0.5}
    assert score(docs.where("false"), labels).count() == 0


def test_disclosures_equal_their_formula_on_a_table(spark):
    """Every pair of the table, counted and scored in plain Python."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    with_entity, with_pair, with_term, n = {}, {}, {}, 0
    for text in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text:
        text, n = text or "", n + 1
        for t in set(word.findall(lower(text))):
            with_term[t] = with_term.get(t, 0) + 1
        spans = pii.find(text)
        words = [(m.start(), m[0]) for m in word.finditer(lower(pii._masked(text, spans)))]
        found = set()
        for s in spans:
            e, at = pii.entity(text, s), sum(i < s[0] for i, _ in words)
            found.add((e, None))
            found |= {(e, t) for _, t in words[max(0, at - 6) : at + 6]}
        for e, t in found:
            counts = with_entity if t is None else with_pair
            key = e if t is None else (e, t)
            counts[key] = counts.get(key, 0) + 1
    want = {}
    for (e, t), k in with_pair.items():
        base = with_entity[e] / n
        value = math.log((k + 0.5 * base) / (max(with_term.get(t, 0), k) + 0.5) / base) / -math.log(base)
        if value >= 0.8:
            code = int(tc.words(pa.array([t])).hashes.view(np.int64)[0])
            want[e, code] = min(value, 1.0)
    for rows in (500_000, 0):
        got = {(r.entity, r.term): r.share for r in pii.disclosures(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), broadcast_rows=rows).collect()}
        assert got.keys() == want.keys() and len(want) > 50
        assert all(got[k] == pytest.approx(want[k]) for k in want)
