"""Rows of a sparse table (e, x, r) against all others, in packed slices.

The entities are cut into ranges of their ids, each packed into one row of a
few bytes an entry. A task holds its own range and takes the ranges that may
share an x with it one after another, so that what is shuffled is a packed copy
of the table for each range at most, whether or not ids lie near those they
share with, and what is held is two ranges.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.operators import blocks
from minewright.operators.blocks import spans
from minewright.operators.cleaning import encode_ids
from minewright.runtime import materialize, ship_package

#: Entries of a range, ranges of a table that has fewer, and bits of a signature.
ENTRIES, RANGES, BITS = 2_000_000, 12, 1 << 16
#: Rows of a batch that a task returns.
ROWS = 200_000


def squeeze(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays, packed: whole numbers of 0 or more in their least size, byte by byte of all."""
    codec, out = pa.Codec("zstd", 1), {}
    for name, a in arrays.items():
        kind = a.dtype.str
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.copy()
        out[name] = kind, a.dtype.str, len(a), codec.compress(planes.tobytes(), asbytes=True)
    return pickle.dumps(out, protocol=5)


def unfold(blob: bytes) -> dict[str, np.ndarray]:
    codec, out = pa.Codec("zstd", 1), {}
    for name, (kind, least, n, packed) in pickle.loads(blob).items():
        wide = np.dtype(least).itemsize
        planes = np.frombuffer(codec.decompress(packed, n * wide, asbytes=True) if n else b"", np.uint8).reshape(wide, n)
        out[name] = np.ascontiguousarray(planes.T).view(least).reshape(n).astype(kind, copy=False)
    return out


def order_of(key: np.ndarray) -> np.ndarray:
    """The stable order of keys of 0 or more: sorted with their places in one number where both fit."""
    bits = max(1, (len(key) - 1).bit_length())
    if len(key) and int(key.max()).bit_length() + bits < 63:
        return np.sort((key.astype(np.int64) << bits) | np.arange(len(key))) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


class Slice:
    """Entities `ids`, ascending, with `sizes` entries x (from the table's least) and r, ascending by x, from `first` on, and their norms."""

    def __init__(self, blob: bytes):
        a = unfold(blob)
        self.ids, self.sizes, self.norm = a["ids"], a["sizes"], a["norm"]
        self.first = np.cumsum(self.sizes) - self.sizes
        sums = np.cumsum(a["step"])
        self.x = sums - np.repeat(sums[self.first] - a["step"][self.first], self.sizes)
        self.r = a["r"] if "r" in a else a["levels"][a["code"]] - np.repeat(a["mean"], self.sizes)

    def by_x(self) -> None:
        """The entries by x: those of `names` lie from `start` on, `count` of each, with their entity and r."""
        order = order_of(self.x)
        x = self.x[order]
        self.start = np.flatnonzero(np.diff(x, prepend=-1))
        self.names, self.count = x[self.start], np.diff(np.append(self.start, len(x)))
        self.entity, self.value = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)[order], self.r[order]
        self.x = self.r = None


def packed(table: pa.Table, centred: bool, least: int, span: int) -> tuple[bytes, bytes]:
    """(blob, signature) of rows (e, x, r), which lie by e and x."""
    e, x = table["e"].to_numpy(), table["x"].to_numpy() - least
    null = table["r"].is_null().to_numpy()
    r = np.where(null, 0.0, table["r"].to_numpy().astype(float))
    first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
    sizes = np.diff(np.append(first, len(e)))
    mean = np.add.reduceat(r, first) / np.maximum(np.add.reduceat(~null, first, dtype=int), 1) if centred else np.zeros(len(first))
    v = np.where(null, 0.0, r - np.repeat(mean, sizes))
    square = np.add.reduceat(v * v, first)
    step = np.diff(x, prepend=0)
    step[first] = x[first]
    arrays = {"ids": e[first], "sizes": sizes, "norm": np.where(square == 0, 1e-9, np.sqrt(square)), "step": step}
    levels = np.unique(r)
    if len(levels) < 256 and not null.any():
        arrays |= {"levels": levels, "code": np.searchsorted(levels, r), "mean": mean}
    else:
        arrays["r"] = v
    sign = np.zeros(BITS, np.uint8)
    sign[(x // (span // BITS + 1)).astype(np.int64)] = 1
    return squeeze(arrays), np.packbits(sign).tobytes()


def whole(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def slices(rows: DataFrame, centred: bool = False) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """((slice, blob) of rows (e long, x long, r), written; the (block, slice) that may share an x; the number of slices).

    rows are read twice: give a written table.
    """
    spark = rows.sparkSession
    ship_package(spark)
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most")).first()
    if not ends["n"]:
        return spark.createDataFrame([], "slice int, blob binary"), [], 0
    n, least, span = ends["n"], ends["least"], ends["most"] - ends["least"] + 1
    parts = max(-(-n // ENTRIES), min(RANGES, n // blocks.LEAST), 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is not None:
            blob, sign = packed(table, centred, least, span)
            yield pa.RecordBatch.from_arrays([table["slice"].combine_chunks()[:1].cast(pa.int32()), pa.array([blob], pa.binary()), pa.array([sign], pa.binary())], ["slice", "blob", "sign"])

    rows = rows.repartitionByRange(parts, "e").sortWithinPartitions("e", "x").select(F.spark_partition_id().alias("slice"), "e", "x", "r")
    out = materialize(rows.mapInArrow(pack, "slice int, blob binary, sign binary"), "slices")
    signs = {r["slice"]: np.frombuffer(r["sign"], np.uint8) for r in out.select("slice", "sign").collect()}
    near = [(i, j) for i in signs for j in signs if i == j or (signs[i] & signs[j]).any()]
    return out.select("slice", "blob"), near, parts


def met(found: DataFrame, near: list[tuple[int, int]], parts: int, task: Callable, schema: str, *more: DataFrame) -> DataFrame:
    """What task(blobs) yields, blobs being, for each block, (slice, blob) of its own slice and then of the others near it; before them those of each of more (slice, blob) as slice -1."""
    spark = found.sparkSession
    to = spark.createDataFrame(near, "block int, slice int")
    sent = found.join(F.broadcast(to), "slice").select("block", (F.col("block") != F.col("slice")).cast("int").alias("turn"), "slice", "blob")
    for i, rows in enumerate(more):
        sent = sent.unionByName(rows.select(F.col("slice").alias("block"), F.lit(i - len(more)).alias("turn"), F.lit(-1).alias("slice"), "blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = ((s.as_py(), b.as_buffer()) for batch in batches for s, b in zip(batch.column(0), batch.column(1)))
        if (first := next(blobs, None)) is not None:
            yield from task(first, blobs)

    return sent.repartitionById(parts, "block").sortWithinPartitions("turn", "slice").select("slice", "blob").mapInArrow(run, schema)


def nearest(own: Slice, other: Slice, same: bool, bar: np.ndarray, k: int | None, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, similarity, other's id) of the k best of each row of own in other, of those at or over the row's bar."""
    other.by_x()
    at = np.minimum(np.searchsorted(other.names, own.names), len(other.names) - 1)
    hit = other.names[at] == own.names
    firsts, lengths = other.start[at][own.back], np.where(hit, other.count[at], 0)[own.back]
    work, width, unit = np.add.reduceat(lengths, own.first), len(other.ids), 10**digits
    dense = work.sum() * 32 >= len(work) * width
    for lo, hi in blocks.chunks(work, blocks.CELLS, max(1, blocks.DENSE // width) if dense else 1 << 14):
        here = np.arange(own.first[lo], own.first[hi - 1] + own.sizes[hi - 1])
        here = here[lengths[here] > 0]
        if not len(here):
            continue
        row, b, dot = blocks.products(hi - lo, firsts[here], own.row[here].astype(np.int64) - lo, own.r[here], lengths[here], other.entity, other.value, width)
        sim = dot / (own.norm[lo:hi][row] * other.norm[b])
        keep = sim * unit >= bar[lo:hi][row] - 0.5
        if same:
            keep &= row + lo != b
        row, sim, b = blocks.best(row[keep], sim[keep], b[keep], width, k, digits)
        if len(row):
            yield row + lo, sim, other.ids[b]


def similar(rows: DataFrame, k: int | None, digits: int, centred: bool = False) -> DataFrame:
    """(a, b, sim) over 0 of rows (e, x, r): cosines, the k greatest of each a by sim and b; centred: of r less e's mean."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("e", "x")}
    rows, names = rows.where("e IS NOT NULL AND x IS NOT NULL"), None
    if not whole(rows, "x"):
        rows = rows.join(encode_ids(rows, "x", "number"), "x").select("e", F.col("number").alias("x"), "r")
    if not whole(rows, "e"):
        names = materialize(encode_ids(rows, "e", "number"), "names")
        rows = rows.join(names, "e").select(F.col("number").alias("e"), "x", "r")
    out = similar_ids(*slices(rows.select(F.col("e").cast("long"), F.col("x").cast("long"), F.col("r").cast("double")), centred), k, digits)
    if names is not None:
        for c in ("a", "b"):
            out = out.join(names.select(F.col("e").alias("name"), F.col("number").alias(c)), c).drop(c).withColumnRenamed("name", c)
    return out.select(F.col("a").cast(kinds["e"]).alias("a"), F.col("b").cast(kinds["e"]).alias("b"), "sim")


def similar_ids(found: DataFrame, near: list[tuple[int, int]], parts: int, k: int | None, digits: int, packed: bool = False) -> DataFrame:
    """(a, b, sim) of slices; packed: (slice, blob) of `row` in the slice, `b` and `sim` instead, by row."""
    spark = found.sparkSession
    if not near:
        return spark.createDataFrame([], "slice int, blob binary" if packed else "a long, b long, sim double")

    def rows_of(own: Slice, a: np.ndarray, sim: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(a), ROWS):
            to = slice(lo, lo + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[a[to]]), pa.array(b[to]), pa.array(sim[to])], ["a", "b", "sim"])

    def run(first: tuple, blobs: Iterator) -> Iterator[pa.RecordBatch]:
        number, own = first[0], Slice(first[1])
        own.names, back = np.unique(own.x, return_inverse=True)
        own.back, own.x, back = back.astype(np.int32), None, None
        own.row = np.repeat(np.arange(len(own.ids), dtype=np.int32), own.sizes)
        bar, held, some, limit = np.ones(len(own.ids)), [], 0, 0

        def turns() -> Iterator[tuple]:
            yield first
            yield from blobs

        def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row, sim, b = (np.concatenate([h[j] for h in held]) if held else np.zeros(0, int) for j in range(3))
            order = np.lexsort((b, -sim, row))
            row, sim, b = row[order], sim[order], b[order]
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            place = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
            last = place == k - 1
            bar[row[last]] = np.floor(sim[last] * 10**digits + 0.5)
            return row[place < k], sim[place < k], b[place < k]

        for turn, blob in turns():
            for part in nearest(own, Slice(blob), turn == number, bar, k, digits):
                if k is None:
                    yield from rows_of(own, *part)
                else:
                    held.append(part)
                    some += len(part[0])
            if k is not None and some > limit:
                held = [kept()]
                some = len(held[0][0])
                limit = 2 * some
        if k is not None:
            row, sim, b = kept()
            if packed:
                blob = squeeze({"row": row, "b": b, "sim": sim})
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([blob], pa.binary())], ["slice", "blob"])
            else:
                yield from rows_of(own, row, sim, b)

    return met(found, near, parts, run, "slice int, blob binary" if packed else "a long, b long, sim double")


def longs(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("e").cast("long"), F.col("x").cast("long"), F.col("r").cast("double"))


class Fetched:
    """The lists of the entities `ids`, ascending: their entries lie from `first` on, `size` of each."""

    def __init__(self, wanted: np.ndarray, blobs: Iterator[tuple[int, bytes]]):
        parts = []
        for _, blob in blobs:
            one = Slice(blob)
            has = np.flatnonzero(np.isin(one.ids, wanted))
            at = spans(one.first[has], one.sizes[has])
            x = one.x[at]
            parts.append((one.ids[has], one.sizes[has], x.astype(np.int32) if x.max(initial=0) < 1 << 31 else x, one.r[at]))
        ids, size, self.x, self.r = (np.concatenate([q[j] for q in parts]) for j in range(4))
        order, first = np.argsort(ids), np.cumsum(size) - size
        self.ids, self.size, self.first = ids[order], size[order], first[order]

    def of(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)


def turned(first: tuple, blobs: Iterator) -> tuple[Slice, np.ndarray, np.ndarray, np.ndarray, Fetched]:
    """(own slice, row, b, sim, the lists of all b) of what `met` gives with packed similar rows before the slices."""
    near, mine = unfold(first[1]), next(blobs)

    def all_blobs() -> Iterator[tuple[int, bytes]]:
        yield mine
        yield from blobs

    fetched = Fetched(np.unique(near["b"]), all_blobs())
    return Slice(mine[1]), near["row"], near["b"], near["sim"].astype(float), fetched


def top_unseen(own: Slice, row: np.ndarray, b: np.ndarray, sim: np.ndarray, lists: Fetched, k: int, digits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, x, score, rank): the k best x that a row hasn't, by the mean of its similar rows' r, weighted by similarity."""
    place, unit = lists.of(b), 10**digits
    heads = np.flatnonzero(np.diff(row, prepend=-1))
    work = np.add.reduceat(lists.size[place], heads) if len(heads) else heads
    ends, wide = np.append(heads[1:], len(row)), int(max(lists.x.max(initial=0), own.x.max(initial=0))) + 1
    for lo, hi in blocks.chunks(work, blocks.CELLS, 1 << 14):
        here, base = slice(heads[lo], ends[hi - 1]), int(row[heads[lo]])
        n = lists.size[place[here]]
        at = spans(lists.first[place[here]], n)
        cell = np.repeat(row[here].astype(np.int64) - base, n) * wide + lists.x[at]
        weight = np.repeat(sim[here], n)
        order = order_of(cell)
        cell = cell[order]
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        score = np.add.reduceat((weight * lists.r[at])[order], starts) / np.add.reduceat(weight[order], starts)
        cell = cell[starts]
        to = int(row[ends[hi - 1] - 1])
        mine = slice(own.first[base], own.first[to] + own.sizes[to])
        seen = np.repeat(np.arange(to - base + 1), own.sizes[base : to + 1]) * wide + own.x[mine]
        free = seen[np.minimum(np.searchsorted(seen, cell), len(seen) - 1)] != cell
        cell = cell[free]
        whole_score = np.copysign(np.floor(np.abs(score[free]) * unit + 0.5), score[free]).astype(np.int64)
        if not len(cell):
            continue
        at, below = cell // wide, whole_score.max() - whole_score
        bits = max(1, int(below.max()).bit_length())
        order = order_of((at << bits) | below) if bits + int(at[-1]).bit_length() < 62 else np.lexsort((cell, below, at))
        at = at[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) + 1
        best = rank <= k
        order = order[best]
        yield at[best] + base, cell[order] % wide, whole_score[order] / unit, rank[best].astype(np.int32)


def user_topk(rows: DataFrame, k: int, k_nn: int, digits: int) -> DataFrame:
    """(user_id, item_id, score, rank) of rows (e long, x long, r): the k best unrated x of each e by its k_nn most similar e.

    The slices are sent twice: for the similar rows, and for their lists.
    """
    spark = rows.sparkSession
    schema = "user_id long, item_id long, score double, rank int"
    rows = rows.where("e IS NOT NULL AND x IS NOT NULL")
    found, near, parts = slices(longs(rows))
    if not near:
        return spark.createDataFrame([], schema)
    least = rows.agg(F.min("x").cast("long")).first()[0]
    similar_rows = materialize(similar_ids(found, near, parts, k_nn, digits, packed=True), "near")

    def run(first: tuple, blobs: Iterator) -> Iterator[pa.RecordBatch]:
        own, *rest = turned(first, blobs)
        for row, x, score, rank in top_unseen(own, *rest, k, digits):
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[row]), pa.array(x.astype(np.int64) + least), pa.array(score), pa.array(rank)], ["user_id", "item_id", "score", "rank"])

    return met(found, near, parts, run, schema, similar_rows)


def folded(df: DataFrame, make: Callable[[pa.Table], dict[str, np.ndarray]], near: list[tuple[int, int]]) -> DataFrame:
    """(slice, blob): all rows of a small table in one blob, for each block."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([squeeze(make(pa.Table.from_batches(batches) if batches else None))], pa.binary())], ["blob"])

    one = materialize(df.repartition(1).mapInArrow(fold, "blob binary"), "folded")
    if one.isEmpty():  # a table known to be empty has no partition
        one = df.sparkSession.createDataFrame([(bytearray(squeeze(make(None))),)], "blob binary")
    return one.join(F.broadcast(df.sparkSession.createDataFrame([(i,) for i in sorted({i for i, _ in near})], "slice int")))


def marked(table: pa.Table | None) -> dict[str, np.ndarray]:
    x, mark = (table["x"].to_numpy(), table["mark"].to_numpy()) if table else (np.zeros(0, int), np.zeros(0, int))
    order = np.argsort(x)
    return {"x": x[order], "mark": mark[order] + 1}


def texts_of(table: pa.Table | None) -> dict[str, np.ndarray]:
    if table is None:
        return {"number": np.zeros(0, int), "length": np.zeros(0, int), "t": np.zeros(0, int), "w": np.zeros(0)}
    table = table.sort_by("number")
    t, length = blocks.flat(table["t"])
    return {"number": table["number"].to_numpy(), "length": length.astype(int), "t": t.astype(int), "w": blocks.flat(table["w"])[0]}


def hybrid_topk(rows: DataFrame, marks: DataFrame, texts: DataFrame, k: int, k_nn: int, cf_weight: float, content_weight: float, digits: int) -> DataFrame:
    """(user_id, item_id, score, rank) of rows (e long, x long, r), as blocks.hybrid_lists tells them, rank 0 alone where these can't be told.

    marks (x, mark) are all items with their class or -1, texts (number, t[],
    w[]) the classes; each task gets both whole.
    """
    spark = rows.sparkSession
    schema = "user_id long, item_id long, score double, rank int"
    rows = rows.where("e IS NOT NULL AND x IS NOT NULL")
    found, near, parts = slices(longs(rows))
    if not near:
        return spark.createDataFrame([], schema)
    least, unit = rows.agg(F.min("x").cast("long")).first()[0], 10**digits
    similar_rows = materialize(similar_ids(found, near, parts, k_nn, digits, packed=True), "near")

    def run(first: tuple, blobs: Iterator) -> Iterator[pa.RecordBatch]:
        items, classes = unfold(first[1]), unfold(next(blobs)[1])
        own, row, b, sim, lists = turned(next(blobs), blobs)
        known, mark = items["x"] - least, items["mark"] - 1
        begin, width = np.cumsum(classes["length"]) - classes["length"], int(classes["t"].max(initial=0)) + 1
        table = begin, classes["length"], classes["t"], classes["w"], width
        place, ends = lists.of(b), np.searchsorted(row, np.arange(len(own.ids) + 1))

        def classed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(whether x is an item, its class or -1)."""
            if not len(known):
                return np.zeros(len(x), bool), np.full(len(x), -1)
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            hit = known[at] == x
            return hit, np.where(hit, mark[at], -1)

        out = []
        for user in range(len(own.ids)):
            mine = own.x[own.first[user] : own.first[user] + own.sizes[user]]
            near = place[ends[user] : ends[user + 1]]
            n = lists.size[near]
            theirs = spans(lists.first[near], n)
            x, back = np.unique(lists.x[theirs], return_inverse=True)
            weight = np.repeat(sim[ends[user] : ends[user + 1]], n)
            score = np.bincount(back, weight * lists.r[theirs], len(x)) / np.bincount(back, weight, len(x))
            x, score = x[score > 0].astype(np.int64), score[score > 0]
            top = blocks.mixed(mine, classed(mine)[1], x, *classed(x), score, table, k, cf_weight, content_weight, unit)
            out.append((user, None, None) if top is None else (user, *top))
            if len(out) * k >= ROWS or user == len(own.ids) - 1:
                some = [o for o in out if o[1] is not None]
                open_ = [o[0] for o in out if o[1] is None]
                user_of = np.concatenate([np.repeat([o[0] for o in some], k).astype(int), np.array(open_, int)])
                item = np.concatenate([o[1] for o in some] + [np.zeros(len(open_), int)])
                value = np.concatenate([o[2] for o in some] + [np.zeros(len(open_))])
                rank = np.concatenate([np.tile(np.arange(1, k + 1), len(some)), np.zeros(len(open_), int)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own.ids[user_of]), pa.array(item + least), pa.array(value), pa.array(rank)], ["user_id", "item_id", "score", "rank"])
                out = []

    return met(found, near, parts, run, schema, folded(marks, marked, near), folded(texts, texts_of, near), similar_rows)
