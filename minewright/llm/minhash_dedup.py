"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle set gives two signature values, its
least and its greatest image, so a signature of 2p values costs p hash
evaluations; both collide with probability equal to the Jaccard similarity.
Bands of `rows` values (half minima, half maxima) are join keys.

Documents with equal sets are one class, of which one text stands for all.
Members of a bucket are not paired with each other: each is compared with the
bucket's centre (its member that shares most buckets with others) on full sets.
The members of a centre are dealt to several tasks, each of which gets the
centre's text once. Those linked to the centre are connected through it. A member x that
isn't could still be linked to another one, y; as both were compared with the
centre, the size of their symmetric difference follows from their differences
to the centre, |x-y| = |Dx| + |Dy| - 2 |Dx and Dy|. So the unlinked members are
held, as a query set in blocks, against all members with the same centre by
these short differences alone. That is exact, each family of copies is treated
once however many buckets it shares, and only links leave the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minewright.llm import textcodes as tc
from minewright.llm.embedding_dedup import forest
from minewright.operators.components import connected_components
from minewright.operators.skew import join_counted
from minewright.runtime import discard, materialize, ship_package

WORDS = 5
PERCENT = 80
BANDS = 32
ROWS = 4
SEED = 20240229
#: Documents on either side of a block, and values of their differences.
TILE = 1024
TILE_VALUES = 1 << 20
#: Members that a task compares with one copy of their centre.
RUN = 512
#: Rows to drop, of 16 bytes, up to which they are broadcast.
BROADCAST_ROWS = 1 << 20


def _sets(w: tc.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and where each text's begin.

    A text of fewer than k words, but not none, has its whole sequence as one.
    """
    at = w.inside(k)
    doc, gram = w.doc_of[at], w.grams(k)[at] if len(at) else np.empty(0, np.uint64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        doc = np.concatenate([doc, short])
        gram = np.concatenate([gram, w.spans(w.docs[:-1][short], w.docs[1:][short])])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    doc, gram = doc[fresh], gram[fresh]
    return gram, np.searchsorted(doc, np.arange(len(w.docs)))


def _signatures(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(SEED)
    half = rows // 2
    factors = rng.integers(0, 1 << 63, bands * half, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * half, np.uint64)
    for batch in tc.chunks(batches):
        gram, cuts = _sets(tc.words(batch.column("text"), lower=True), k)
        size = np.diff(cuts)
        full = np.flatnonzero(size)
        at = cuts[:-1][full]
        keys = np.zeros((len(full), bands), np.uint64)
        s1 = s2 = np.empty(0, np.uint64)
        if len(full):
            for p, (a, b) in enumerate(zip(factors, shifts, strict=True)):
                image = gram * a + b
                band = p // half
                keys[:, band] = tc.mix(keys[:, band] * np.uint64(3) + np.minimum.reduceat(image, at))
                keys[:, band] = tc.mix(keys[:, band] * np.uint64(5) + np.maximum.reduceat(image, at))
            keys = tc.mix(keys + np.arange(bands, dtype=np.uint64) * tc.SALT)
            s1 = tc.mix(np.add.reduceat(tc.mix(gram), at))
            s2 = tc.mix(np.add.reduceat(tc.mix(gram ^ tc.SALT), at))
        signed = np.zeros((batch.num_rows, bands), np.uint64)
        signed[full] = keys
        sums = np.zeros((2, batch.num_rows), np.uint64)
        sums[:, full] = s1, s2
        cut = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(size.astype(np.int64)),
                pa.array(sums[0].view(np.int64)),
                pa.array(sums[1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(keys.reshape(-1).view(np.int64))),
            ],
            ["doc_id", "text_key", "n_shingles", "s1", "s2", "bands"],
        )


def _differences(member: np.ndarray, cuts: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the intersections of some sets with that of their centre, and the symmetric differences with their cuts."""
    n = len(cuts) - 1
    owner = np.repeat(np.arange(n), np.diff(cuts))
    at = np.minimum(np.searchsorted(centre, member), len(centre) - 1)
    there = centre[at] == member
    missing = np.ones((n, len(centre)), bool)
    missing[owner[there], at[there]] = False
    row, column = np.nonzero(missing)
    doc, gram = np.concatenate([owner[~there], row]), np.concatenate([member[~there], centre[column]])
    order = np.argsort(doc, kind="stable")
    return np.bincount(owner[there], minlength=n), gram[order], np.searchsorted(doc[order], np.arange(n + 1))


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sizes of intersection and union of the sets of a and its centre b, and their symmetric difference.

    Rows come sorted by (b, part, member, a), so that a part's first row is its centre.
    """
    key, centre, last = None, np.empty(0, np.uint64), None
    for batch in tc.chunks(batches):
        gram, cuts = _sets(tc.words(batch.column("text"), lower=True), k)
        a, b, part, member = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "part", "member"))
        lo = 0
        while lo < len(a):
            if (b[lo], part[lo]) != key:
                key, last, centre = (b[lo], part[lo]), None, gram[cuts[lo] : cuts[lo + 1]]
            if not member[lo] or a[lo] == last:  # the centre, or another row with the same text
                lo += 1
                continue
            hi = lo + 1
            room = max(1, (8 << 20) // max(1, len(centre)))
            while hi < len(a) and hi - lo < room and (b[hi], part[hi]) == key and a[hi] != a[hi - 1]:
                hi += 1
            last = a[hi - 1]
            size = np.diff(cuts[lo : hi + 1])
            common, delta, at = _differences(gram[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo], centre)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(a[lo:hi]),
                    pa.array(b[lo:hi]),
                    pa.array(size.astype(np.int64)),
                    pa.array(common.astype(np.int64)),
                    pa.array((size + len(centre) - common).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(delta.view(np.int64))),
                ],
                ["a", "b", "size", "common", "total", "delta"],
            )
            lo = hi


def _measure(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Each pair of classes (a, b) compared on full sets; each text is shuffled once for its pairs, and a centre's once for each part of its members."""
    total = pairs.count()
    centres = materialize(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / RUN)), "mm-parts")
    dealt = join_counted(pairs, centres, ["b"], total).select("a", "b", F.pmod(F.xxhash64("a"), "parts").alias("part"), F.lit(True).alias("member"))
    heads = centres.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"))
    named = dealt.unionByName(heads).join(classes.select(F.col("cls").alias("a"), "id", "text_key"), "a")
    rows = docs.join(named, ["id", "text_key"]).select("a", "b", "part", "member", "text")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", "member", "a")
    return rows.mapInArrow(partial(_compare, k=k), "a long, b long, size long, common long, total long, delta array<long>")


def _links(rows: pa.Table, percent: int) -> pa.Table | None:
    """Links between the seeking rows of a block and its other rows, as a spanning forest."""
    doc, size, seek = rows.column("a").to_numpy(), rows.column("size").to_numpy(), rows.column("seek").to_numpy()
    lists = rows.column("delta").combine_chunks()
    length = lists.value_lengths().to_numpy().astype(np.int64)
    names, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    owner = np.repeat(np.arange(len(doc)), length)
    p, q = np.flatnonzero(seek), np.flatnonzero(~seek)
    if not len(p) or not len(q):
        return None
    # Only what is in a difference on both sides can be common to two.
    use = np.flatnonzero((np.bincount(column[seek[owner]], minlength=len(names)) > 0) & (np.bincount(column[~seek[owner]], minlength=len(names)) > 0))
    place = np.full(len(names), -1)
    place[use] = np.arange(len(use))
    column = place[column]
    common = np.zeros((len(p), len(q)), np.float32)
    row = np.empty(len(doc), np.int64)
    row[p], row[q] = np.arange(len(p)), np.arange(len(q))
    for lo in range(0, len(use), 2048):
        own = (column >= lo) & (column < lo + 2048)
        side = []
        for has, n in ((own & seek[owner], len(p)), (own & ~seek[owner], len(q))):
            x = np.zeros((n, min(2048, len(use) - lo)), np.float32)
            x[row[owner[has]], column[has] - lo] = 1
            side.append(x)
        common += side[0] @ side[1].T
    apart = length[p][:, None] + length[q][None, :] - 2 * common.astype(np.int64)
    total = size[p][:, None] + size[q][None, :]
    # 100 * (total - apart) / 2 >= percent * (total + apart) / 2
    i, j = np.nonzero((100 * (total - apart) >= percent * (total + apart)) & (doc[p][:, None] != doc[q][None, :]))
    if not len(i):
        return None
    names, back = np.unique(np.concatenate([doc[p][i], doc[q][j]]), return_inverse=True)
    tree = forest(back[: len(i)], back[len(i) :], len(names))
    return pa.table({"src": doc[p][i][tree], "dst": doc[q][j][tree]})


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (b, left, right), a block each."""
    held: list[pa.RecordBatch] = []
    key = None

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            found = _links(pa.Table.from_batches(held), percent)
            if found is not None:
                yield from found.to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("b", "left", "right")], 1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = tuple(keys[lo].tolist())
            if now != key:
                yield from done()
                held, key = [], now
            held.append(batch.slice(lo, hi - lo))
    yield from done()


def _beyond_stars(star: DataFrame, linked: str, percent: int) -> DataFrame:
    """Links (src, dst) of members that aren't linked to their centre b, among all with that centre."""
    open_ = F.expr(f"int(not ({linked}))")
    long = F.size("delta").cast("long")
    sizes = star.groupBy("b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(open_).alias("open"), F.sum(long).alias("values"), F.sum(open_ * long).alias("open_values")
    )
    sizes = sizes.where("open > 0 and n > 1").select(
        "b",
        "n",
        F.ceil(F.greatest(F.col("n") / TILE, F.col("values") / TILE_VALUES)).cast("int").alias("across"),
        F.ceil(F.greatest(F.col("open") / TILE, F.col("open_values") / TILE_VALUES)).cast("int").alias("down"),
    )
    sizes = materialize(sizes, "mm-families")
    rows = star.select("a", "b", "size", "delta", F.expr(f"not ({linked})").alias("unlinked"))
    tiles = join_counted(rows, sizes, ["b"], star.count())
    spot = F.xxhash64("a")
    seeking = tiles.where("unlinked").select(
        "a", "b", "size", "delta", F.lit(True).alias("seek"), F.pmod(spot, F.col("down")).cast("int").alias("left"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("right")
    )
    sought = tiles.select(
        "a", "b", "size", "delta", F.lit(False).alias("seek"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("left"), F.pmod(spot, F.col("across")).cast("int").alias("right")
    )
    dealt = seeking.unionByName(sought).repartition("b", "left", "right").sortWithinPartitions("b", "left", "right")
    return dealt.mapInArrow(partial(_blocks, percent=percent), "src long, dst long")


def _linked_classes(usable: DataFrame, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets of usable rows, and the links (src, dst) between classes.

    A class has a number cls, its set's key (s1, s2, n_shingles), the least id
    in it with the text_key of such a row, and its number of rows n.
    """
    classes = usable.groupBy("s1", "s2", "n_shingles").agg(
        F.min("id").alias("id"), F.min_by("text_key", "id").alias("text_key"), F.count(F.lit(1)).alias("n"), F.any_value("bands").alias("bands")
    )
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "mm-classes")
    keyed = materialize(classes.select("cls", F.explode("bands").alias("bucket")), "mm-keyed")
    crowd = materialize(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "mm-crowd")
    shared = materialize(join_counted(keyed, crowd, ["bucket"], keyed.count()), "mm-buckets")
    discard(keyed)
    mass = shared.groupBy("cls").agg(F.sum("n").alias("mass"))
    placed = materialize(shared.join(mass, "cls").select("bucket", "n", "cls", F.struct("mass", -F.col("cls")).alias("rank")), "mm-placed")
    discard(shared)
    centre = placed.groupBy("bucket").agg(F.max("rank").alias("top"), F.first("n").alias("n"))
    centre = materialize(centre.select("bucket", (-F.col("top").getField("col2")).alias("centre"), "n"), "mm-centres")
    pairs = join_counted(placed.select("bucket", "cls"), centre, ["bucket"], placed.count())
    pairs = materialize(pairs.where("cls <> centre").select(F.col("cls").alias("a"), F.col("centre").alias("b")).distinct(), "mm-pairs")
    discard(placed, centre, crowd)
    star = materialize(_measure(pairs, classes, docs, words), "mm-star")
    discard(pairs)
    linked = f"100 * common >= {percent} * total"
    links = star.where(linked).select(F.col("a").alias("src"), F.col("b").alias("dst")).union(_beyond_stars(star, linked, percent))
    links = materialize(links, "mm-links")
    discard(star)
    return classes, links


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Group documents whose sets of `words`-word shingles are alike.

    A-Z are lower-cased; a word is a run of characters other than white space.
    Two documents are linked where 100 * |A and B| >= percent * |A or B|,
    confirmed on the full sets. Returns for each row of docs (doc_id, text):
    doc_id, n_shingles, component_id (the smallest id reachable over links)
    and kept (whether it is its own component_id).

    Null, empty and blank texts have an empty set and link with nothing.
    Documents without an id get a null component_id and are kept. Rows that
    share an id are one node, which takes the links of all of them. Other
    columns are not read; an empty table gives no rows.

    A pair at similarity s shares a bucket with probability
    1 - (1 - s**rows)**bands: at 0.8, all but 5e-8 of them.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("text_key"))
    signed = _signed(docs, words, bands, rows)
    usable = signed.where("n_shingles > 0 and doc_id is not null").withColumn("id", F.col("doc_id"))
    classes, links = _linked_classes(usable, docs, words, percent)
    set_key = ["s1", "s2", "n_shingles"]
    total = signed.count()
    member = materialize(join_counted(usable.select("id", *set_key), classes.select(*set_key, "n", "cls"), set_key, total).select("id", "cls").distinct(), "mm-members")
    # An id whose rows are in several classes links them.
    several = member.groupBy("id").agg(F.min("cls").alias("src"), F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = member.join(several, "id").where("cls <> src").select("src", F.col("cls").alias("dst"))
    label = _components(classes, links.union(shared), F.min("id").alias("component"))
    named = materialize(classes.select(*set_key, "n", "cls").join(label, "cls").drop("cls"), "mm-named")
    discard(member, links, classes)
    found = join_counted(signed.select("doc_id", *set_key), named, set_key, total, how="left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    return materialize(
        docs.select("doc_id", "text", "text_key").mapInArrow(
            partial(_signatures, k=words, bands=bands, rows=rows),
            "doc_id long, text_key long, n_shingles long, s1 long, s2 long, bands array<long>",
        ),
        "mm-signed",
    )


def _components(classes: DataFrame, links: DataFrame, what: Column) -> DataFrame:
    """(cls, ...): the aggregate `what` over all classes that are linked with each class."""
    label = connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("root"))
    rooted = classes.select("cls", "id", "text_key").join(label, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = materialize(rooted, "mm-rooted")
    whole = materialize(rooted.groupBy("root").agg(what, F.count(F.lit(1)).alias("n")), "mm-components")
    return join_counted(rooted.select("cls", "root"), whole, ["root"], rooted.count()).drop("root", "n")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each group of rows that near_duplicates would link, and all others; all columns.

    Every row is a document of its own, whether it shares its id or has none.
    The least id of a group stays, null last; of rows that share it, the one
    whose text has the least hash, and of equal rows one. Null, empty and
    blank texts all stay. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    given = docs.columns
    docs = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__key": F.xxhash64("text")})
    plain = docs.select(F.col("__id").alias("doc_id"), F.col("__id").alias("id"), "text", F.col("__key").alias("text_key"))
    signed = _signed(plain, words, bands, rows)
    usable = signed.where("n_shingles > 0").withColumn("id", F.col("doc_id"))
    classes, links = _linked_classes(usable, plain, words, percent)
    # In a class, the row that stays if the class's does: its least id, and then its least text_key.
    set_key = ["s1", "s2", "n_shingles"]
    first = _components(classes, links, F.min(F.struct("id", "text_key")).alias("first"))
    named = materialize(classes.select(*set_key, "n", "cls").join(first, "cls").drop("cls"), "mm-named")
    discard(links, classes)
    mine = join_counted(usable.select("id", "text_key", *set_key), named, set_key, signed.count())
    verdict = mine.groupBy("id", "text_key").agg(F.first(F.struct("id", "text_key") == F.col("first")).alias("stays"), F.count(F.lit(1)).alias("k")).where("not stays or k > 1")
    verdict = materialize(verdict.select(F.col("id").alias("__id"), F.col("text_key").alias("__key"), "stays"), "mm-verdict")
    # Rows to drop, and (stays) those of which one is to stay; the texts are shuffled only where these are too many to broadcast.
    small = verdict.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = F.broadcast if small else lambda df: df
    kept = docs.join(sent(verdict), ["__id", "__key"], "left_anti")
    if verdict.where("stays").limit(1).count():
        kept = kept.unionByName(docs.join(sent(verdict.where("stays")), ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"]))
    return kept.select(given)
