"""The corpus operators against brute-force versions on small fixtures."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import database, differences
from minewright.llm import minhash_dedup, queries, substring_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_groups(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return sets, root


def brute_removed(texts, span):
    first = {}
    words = [WORD.findall(t or "") for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - span + 1):
            first.setdefault(tuple(w[i : i + span]), d)
    out = []
    for d, w in enumerate(words):
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] < d:
                gone.update(range(i, i + span))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


BASE = [f"word{i}" for i in range(120)]
TEXTS = [" ".join(BASE), " ".join(BASE), " ".join(BASE[:115] + ["other"]), "", None, "  \t", "one", "One", " ".join(["x y"] + BASE[20:90]), "a b c d e", " ".join(["loop"] * 300), "été é 漢字 x"]


def test_near_duplicates(spark):
    sets, root = brute_groups(TEXTS, 2, 80)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs(spark, TEXTS), words=2, percent=80).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), root[d], root[d] == d) for d in range(len(TEXTS))}


def test_remove_repeats(spark):
    got = substring_dedup.remove_repeats(docs(spark, TEXTS), span=50).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == dict(enumerate(brute_removed(TEXTS, 50)))


@pytest.mark.parametrize("empty", [True, False])
def test_empty_table_and_extra_columns(spark, empty):
    given = docs(spark, TEXTS).withColumn("n_shingles", F.lit("clash")).withColumn("kept", F.lit(None).cast("int"))
    given = given.where("false") if empty else given
    assert minhash_dedup.near_duplicates(given, words=2).count() == (0 if empty else len(TEXTS))
    assert substring_dedup.remove_repeats(given, span=50).count() == (0 if empty else len(TEXTS))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF).toPandas(), database(SF).execute(queries.ORACLE_SQL[name]).df()) is None


def test_packing_is_gapless(spark):
    got = queries.op4_packing(spark, SF).toPandas()
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        ends = (pieces["offset"] + pieces["length"]).tolist()
        assert pieces["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= 4096
    for _, pieces in got.sort_values("start").groupby("doc_id"):
        ends = (pieces["start"] + pieces["length"]).tolist()
        assert pieces["start"].tolist() == [0, *ends[:-1]] and ends[-1] == pieces["doc_tokens"].iloc[0]


def grouped(df):
    return {(r.doc_id, r.component_id, r.kept) for r in df.collect()}


def near(text, k=3):
    return text.replace("word7 ", f"other{k} ")


def test_rows_that_share_an_id_take_the_links_of_all(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in ("word", "thing"))
    rows = [(5, a), (5, b), (6, near(a)), (7, b.replace("thing7 ", "else ")), (8, None), (None, a), (None, None), (9, "alone in here")]
    for given in (rows, rows[::-1]):
        got = minhash_dedup.near_duplicates(spark.createDataFrame(given, "doc_id long, text string"), words=2)
        assert grouped(got) == {(5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True), (9, 9, True), (None, None, True)}
        assert got.count() == len(rows)


def test_one_row_of_each_group_stays(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in ("word", "thing"))
    rows = [(5, a), (5, a), (5, a), (6, a), (7, b), (7, near(a)), (8, None), (8, None), (8, ""), (None, a), (None, "only one"), (None, "only one"), (None, "another one"), (3, b.upper()), (4, " \t")]
    given = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = minhash_dedup.drop_near_duplicates(given)
    assert got.columns == given.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(5, a), (3, b.upper()), (8, None), (8, None), (8, ""), (None, "only one"), (None, "another one"), (4, " \t")], key=str)
    assert minhash_dedup.drop_near_duplicates(given.where("false")).count() == 0


def test_families_of_near_copies_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(40)]
        for _ in range(25):
            words = list(base)
            for i in rng.integers(0, 40, int(rng.integers(0, 7))):
                words[i] = f"r{rng.integers(0, 5)}"
            texts.append(" ".join(words[: int(rng.integers(32, 41))]))
    texts += texts[:10] + [" ".join(f"l{i % 7000}" for i in range(20000)), " ".join(f"l{i % 7000}" for i in range(19000))]
    sets, root = brute_groups(texts, 2, 80)
    for tile, run in ((1024, 512), (4, 3)):
        monkeypatch.setattr(minhash_dedup, "TILE", tile)
        monkeypatch.setattr(minhash_dedup, "RUN", run)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs(spark, texts), words=2, percent=80).collect()}
        assert got == {d: (len(sets[d]), root[d]) for d in range(len(texts))}


def test_remove_repeats_of_shared_ids_and_long_texts(spark):
    run = [f"r{i}" for i in range(70)]
    long = [f"u{i % 9000}" for i in range(30000)]
    rows = [(1, " ".join(run)), (1, " ".join(run)), (1, " ".join(["x", *run[:60]])), (2, " ".join([*run[5:], "y", *run[:55]])), (3, " ".join(long)), (4, " ".join(long[12000:25000])), (None, " ".join(run)), (5, " ".join(run[:49]))]
    earlier, want = {}, []
    for d, text in rows:
        w = WORD.findall(text)
        for i in range(len(w) - 49):
            if d is not None:
                earlier[tuple(w[i : i + 50])] = min(d, earlier.get(tuple(w[i : i + 50]), d))
    for d, text in rows:
        w, gone = WORD.findall(text), set()
        for i in range(len(w) - 49):
            if d is not None and earlier[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_remove_repeats_on_a_table(spark):
    import pandas as pd

    table = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id")
    want = dict(zip(table.doc_id.tolist(), brute_removed(table.text.tolist(), 50), strict=True))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3_substring_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and sum(n > 0 for _, n, _ in want.values()) > 50


def test_near_duplicates_on_a_table(spark):
    import pandas as pd

    table = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id")
    ids, sets = table.doc_id.tolist(), [shingles(t, 2) for t in table.text]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(ids))}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_minhash_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == want
