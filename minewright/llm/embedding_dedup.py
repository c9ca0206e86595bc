"""Near-duplicate embeddings by spherical-cap filters.

Vectors are turned by a random rotation and cut into two parts. Each part has
a small code of random directions, and a filter is one choice from each part's
code, so that B*B filter directions cost only 2*B dot products; those that a
vector exceeds are found by list decoding (extending choices for the first
part that can still reach the threshold). `codes` such product codes, each
with a rotation of its own, even out how many filters a vector has. Vectors in
the same filter are compared in double precision in blocks; a pair counts in
the first filter that both have, so pairs are neither repeated nor shuffled.

Threshold and number of filters follow from the number of vectors by one
rule at every size: a filter holds `load` vectors on average, and a pair at
exactly the wanted cosine is expected in `hits` common filters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.operators.components import connected_components
from minewright.runtime import materialize, ship_package

COSINE = 0.9
LOAD = 512
HITS = 10
CODES = 6
TILE = 1024
SEED = 19790523


def tail(alpha: float, dim: int) -> float:
    """Share of the unit sphere whose product with a fixed direction is alpha or more."""
    if alpha >= 1:
        return 0.0
    x = np.linspace(alpha, 1, 4001)
    density = (1 - x * x) ** ((dim - 3) / 2)
    scale = math.gamma(dim / 2) / (math.sqrt(math.pi) * math.gamma((dim - 1) / 2)) if dim < 300 else math.sqrt(dim / (2 * math.pi))
    return float(scale * np.trapezoid(density, x))


def plan(n: int, dim: int, cosine: float, load: float, hits: float, codes: int) -> tuple[float, int]:
    """Filter threshold, and the size of each part's code, for n vectors."""
    share = min(0.25, load / max(n, 1))
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid, dim) > share else (lo, mid)
    # Chance that a vector at that cosine exceeds a filter too: over where in the cap the first lies.
    x = np.linspace(lo, min(1.0, lo + 0.6), 301)[:-1]
    weight = (1 - x * x) ** ((dim - 3) / 2)
    reach = (lo - cosine * x) / (math.sqrt(max(1e-12, 1 - cosine * cosine)) * np.sqrt(1 - x * x))
    other = [tail(r, dim - 1) if r >= 0 else 1 - tail(-r, dim - 1) for r in np.clip(reach, -1, 1)]
    both = float((weight * other).sum() / weight.sum())
    filters = hits / max(both, 1e-6) / share
    return lo, max(2, math.ceil(math.sqrt(filters / codes)))


class Code:
    """The rotations and codes of all filters; the same for every task."""

    def __init__(self, dim: int, size: int, codes: int):
        rng = np.random.default_rng(SEED)
        self.size, half = size, max(1, dim // 2)
        self.parts = [(0, half), (half, dim)]
        self.turns, self.words = [], []
        for _ in range(codes):
            self.turns.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
            words = []
            for a, b in self.parts:
                c = rng.standard_normal((size, b - a))
                norm = np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
                words.append(c / norm * math.sqrt((b - a) / dim))
            self.words.append(words)

    def decode(self, x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter direction that a row of x exceeds."""
        rows, keys = [], []
        for s, (turn, words) in enumerate(zip(self.turns, self.words, strict=True)):
            y = x @ turn
            one, two = (y[:, a:b] @ c.T for (a, b), c in zip(self.parts, words, strict=True))
            row, j = np.nonzero(one >= (alpha - two.max(1))[:, None])
            i, k = np.nonzero(two[row] >= (alpha - one[row, j])[:, None])
            rows.append(row[i])
            keys.append((s * self.size + j[i]) * self.size + k)
        return np.concatenate(rows), np.concatenate(keys)


def units(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision from stored bytes of either width."""
    if all(len(b) == 4 * dim for b in raw):
        x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim).astype(np.float64)
    else:
        x = np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in raw]).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes (single precision where that is exact); null where they link with nothing."""
    for batch in batches:
        lists = batch.column("embedding")
        size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        begin = np.cumsum(size) - size
        out: list[bytes | None] = [None] * batch.num_rows
        dims = np.zeros(batch.num_rows, np.int32)
        for d in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == d)
            x = flat[begin[own][:, None] + np.arange(d)] + 0.0
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            with np.errstate(over="ignore", invalid="ignore"):
                narrow = x.astype(np.float32)
                exact = (narrow.astype(np.float64) == x).all(1)
            for i, row in enumerate(own.tolist()):
                if ok[i]:
                    out[row] = (narrow[i] if exact[i] else x[i]).tobytes()
                    dims[row] = d
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary()), pa.array(dims)], ["vec_id", "unit", "dim"])


def _filters(batches: Iterator[pa.RecordBatch], plans: dict[int, tuple[float, int]], n_codes: int) -> Iterator[pa.RecordBatch]:
    codes: dict[int, Code] = {}
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                alpha, size = plans[dim]
                if dim not in codes:
                    codes[dim] = Code(dim, size, n_codes)
                code = codes[dim]
                own = np.flatnonzero(dims == dim)
                x = units(batch.column("unit").take(pa.array(own)).to_pylist(), dim)
                row, key = code.decode(x, alpha)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                cuts = np.searchsorted(row, np.arange(len(own) + 1)).astype(np.int32)
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("rep", "copies", "unit", "dim")), pa.ListArray.from_arrays(pa.array(cuts), pa.array(key))],
                    ["rep", "copies", "unit", "dim", "filters"],
                )


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of links that connect all that the links (a, b) connect."""
    root, keep = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return np.array(keep, np.int64)


def _tile(rows: pa.Table, left: int, right: int, cosine: float) -> pa.Table | None:
    """Verified links of one filter between its tiles left and right: counts for each vector, and a spanning forest."""
    rep, copies, tile = (rows.column(c).to_numpy() for c in ("rep", "copies", "tile"))
    dim, mine = rows.column("dim")[0].as_py(), rows.column("filter")[0].as_py()
    x = units(rows.column("unit").to_pylist(), dim)
    p, q = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
    i, j = np.nonzero(x[p] @ x[q].T >= cosine - 1e-12)
    i, j = p[i], q[j]
    if left == right:
        i, j = i[i < j], j[i < j]
    # BLAS may add in another order than a plain sum; pairs on the threshold are settled by one rule.
    near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
    i, j = i[near], j[near]
    if not len(i):
        return None
    lists = rows.column("filters").combine_chunks()
    flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(rep)), lists.value_lengths().to_numpy())
    before = flat < mine
    names, column = np.unique(flat[before], return_inverse=True)
    has = np.zeros((len(rep), len(names)), bool)
    has[owner[before], column] = True
    packed = np.packbits(has, axis=1)
    first = np.concatenate([~(packed[i[k : k + 8192]] & packed[j[k : k + 8192]]).any(1) for k in range(0, len(i), 8192)])
    i, j = i[first], j[first]
    if not len(i):
        return None
    count = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
    has = np.flatnonzero(count)
    tree = forest(i, j, len(rep))
    return pa.table(
        {
            "a": np.concatenate([rep[has], rep[i[tree]]]),
            "b": np.concatenate([np.full(len(has), -1), rep[j[tree]]]),
            "links": np.concatenate([count[has].astype(np.int64), np.zeros(len(tree), np.int64)]),
            "edge": np.concatenate([np.zeros(len(has), bool), np.ones(len(tree), bool)]),
        }
    )


def _join(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (dim, filter, left, right); each such group is at most two tiles."""
    held: list[pa.RecordBatch] = []
    key = None

    def done() -> Iterator[pa.RecordBatch]:
        if held and sum(b.num_rows for b in held) > 1:
            found = _tile(pa.Table.from_batches(held), key[2], key[3], cosine)
            if found is not None:
                yield from found.to_batches()

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "filter", "left", "right")], 1)
        if not len(keys):
            continue
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = tuple(keys[lo].tolist())
            if now != key:
                yield from done()
                held, key = [], now
            held.append(batch.slice(lo, hi - lo))
    yield from done()


def near_vectors(vectors: DataFrame, cosine: float = COSINE, load: float = LOAD, hits: float = HITS, codes: int = CODES) -> DataFrame:
    """Link vectors (vec_id, embedding) with a cosine of at least `cosine`, in double precision.

    Returns one row for each input row: vec_id, n_links (other rows linked
    directly), component_id (the smallest vec_id reachable) and kept.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, as do rows without a vec_id (their component_id is
    null, and they are kept). Vectors of different lengths are not compared.
    Equal vectors are one class: n_links counts every row of it, and rows
    that share an id are rows of their own. Other columns are not read; an
    empty table gives no rows.
    """
    ship_package(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = materialize(vectors.mapInArrow(_clean, "vec_id long, unit binary, dim int"), "cap-units")
    known = known.withColumn("key", F.sha2("unit", 256))
    usable = known.where("unit is not null and vec_id is not null")
    classes = usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("unit").alias("unit"), F.any_value("dim").alias("dim"))
    classes = materialize(classes, "cap-classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    plans = {d: plan(n, d, cosine, load, hits, codes) for d, n in sizes.items()}
    coded = materialize(
        classes.select("rep", "copies", "unit", "dim").mapInArrow(
            partial(_filters, plans=plans, n_codes=codes), "rep long, copies long, unit binary, dim int, filters array<long>"
        ),
        "cap-coded",
    )
    each = coded.withColumn("filter", F.explode("filters"))
    counts = each.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A crowded filter is dealt to tiles; a task sees two tiles at most.
    each = each.join(counts, ["dim", "filter"]).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    each = each.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    each = each.select("rep", "copies", "unit", "dim", "filter", "filters", "tile", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"))
    dealt = each.repartition("dim", "filter", "left", "right").sortWithinPartitions("dim", "filter", "left", "right")
    found = materialize(dealt.mapInArrow(partial(_join, cosine=cosine), "a long, b long, links long, edge boolean"), "cap-found")
    degree = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    near = found.where("edge").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    named = usable.join(classes.select("key", "rep", "copies"), "key")
    same = named.where("vec_id <> rep").select(F.col("vec_id").alias("src"), F.col("rep").alias("dst"))
    label = connected_components(near.union(same))
    full = (
        named.join(degree, "rep", "left")
        .select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        .union(known.where("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("long")))
        .join(label.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .withColumn("component_id", F.coalesce("component", "vec_id"))
    )
    return full.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
