"""Similar rows of a sparse table (e, x, r), in blocks of entities that lie together.

The entities are cut into ranges of their ids. A block gets, once, the list of
every x that one of its entities has, and multiplies in memory: what is
shuffled grows with the lists and not with the pairs that share an x, and the
less the nearer the ids of such pairs lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minewright.runtime import materialize, ship_package

#: Products of a block on average, blocks at least (with LEAST rows each), products held at once and dense cells, which should fit a cache.
PRODUCTS, BLOCKS, LEAST, CELLS, DENSE = 24_000_000, 24, 2_000, 1 << 20, 1 << 18


def ranges(sizes: DataFrame, key: str, limit: int) -> DataFrame:
    """sizes (key, n) with block: ranges of keys with at most about `limit` of n; a greater key is alone or ends its range."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // limit))
    cut = materialize(sizes.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return cut.select("*", (F.col("part") * (1 << 20) + F.floor(before / limit)).cast("long").alias("block")).drop("part")


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def spans(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places firsts[i] .. firsts[i] + lengths[i] - 1 of all i, in turn."""
    ends = np.cumsum(lengths)
    return np.repeat(firsts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def chunks(work: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` of work, unless one row has more, and at most `rows` rows."""
    ends, at = np.cumsum(work), 0
    while at < len(work):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        to = min(max(to, at + 1), at + rows)
        yield at, to
        at = to


def products(rows: int, firsts: np.ndarray, owner: np.ndarray, value: np.ndarray, lengths: np.ndarray, other: np.ndarray, r: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, dot) of the cells over 0 of rows by width; entry i of the rows meets the places firsts[i] and on."""
    total = int(lengths.sum())
    if rows * width <= max(32 * total, 1 << 16):
        out = None
        for lo, hi in chunks(lengths, CELLS, len(lengths)):
            at = spans(firsts[lo:hi], lengths[lo:hi])
            part = np.bincount(np.repeat(owner[lo:hi] * width, lengths[lo:hi]) + other[at], np.repeat(value[lo:hi], lengths[lo:hi]) * r[at], rows * width)
            out = part if out is None else out + part
        cell = np.flatnonzero(out > 0)
        a = cell // width
        return a, cell - a * width, out[cell]
    at = spans(firsts, lengths)
    cell = np.repeat(owner * width, lengths) + other[at]
    bits = max(1, (total - 1).bit_length())
    if bits + (rows * width).bit_length() < 63:  # cell and place in one number, which sorts faster than an order of cells
        cell = np.sort((cell << bits) | np.arange(total))
        order = cell & ((1 << bits) - 1)
        cell >>= bits
    else:
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    dot = np.add.reduceat((np.repeat(value, lengths) * r[at])[order], starts) if total else np.zeros(0)
    more = dot > 0
    cell = cell[starts][more]
    return cell // width, cell % width, dot[more]


def best(row: np.ndarray, score: np.ndarray, item: np.ndarray, width: int, k: int | None, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, score, item) of the k best of each row by score, rounded half up, and then by item, below width; scores 0..1."""
    unit = 10**digits
    s = np.floor(score * unit + 0.5).astype(np.int64)
    bits, low = int(unit).bit_length() + 1, max(1, int(width - 1).bit_length())
    code = np.sort((row << (bits + low)) | ((2 * unit - s) << low) | item) if bits + low + int(row.max(initial=0)).bit_length() < 63 else None
    if code is None:
        order = np.lexsort((item, -s, row))
        row, s, item = row[order], s[order], item[order]
    else:
        row, s, item = code >> (bits + low), 2 * unit - ((code >> low) & ((1 << bits) - 1)), code & ((1 << low) - 1)
    if k is not None:
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        near = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row)))) < k
        row, s, item = row[near], s[near], item[near]
    return row, s / unit, item


def similar(vectors: DataFrame, k: int | None, digits: int, only: DataFrame | None = None) -> DataFrame:
    """(a, b, sim) over 0 of vectors (e, x, r, q), q being e's sum of squares: cosines, the k greatest of each a by sim and b.

    only (e): the entities to stand as a. A task holds the lists of one block
    and works through its entities in chunks; an x that very many have is one
    row, and its pairs remain the square of that.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema["e"].dataType.simpleString()
    vectors = materialize(vectors.where("e IS NOT NULL AND x IS NOT NULL"), "vectors")
    own = vectors if only is None else vectors.join(F.broadcast(only.select("e").distinct()), "e", "left_semi")
    lists = own.select("x").distinct() if only is not None else None
    reached = vectors if lists is None else vectors.join(F.broadcast(lists), "x", "left_semi")
    lengths = reached.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("pairs")).first()
    if not lengths["n"]:
        return spark.createDataFrame([], f"a {kind}, b {kind}, sim double")
    limit = int(max(LEAST, min(PRODUCTS * lengths["n"] / lengths["pairs"], lengths["n"] / BLOCKS)))
    blocks = materialize(ranges(own.groupBy("e").agg(F.count(F.lit(1)).alias("n")), "e", limit).select("e", "block"), "blocks")
    if only is not None:
        blocks = F.broadcast(blocks)
    entry = F.struct("e", F.coalesce("r", F.lit(0.0)).alias("r"), "q", F.coalesce("block", F.lit(-1)).alias("block"))
    lists = reached.join(blocks, "e", "left").groupBy("x").agg(F.collect_list(entry).alias("s"), F.collect_set("block").alias("to"))
    sent = lists.select(F.explode("to").alias("block"), F.col("s.e").alias("e"), F.col("s.r").alias("r"), F.col("s.q").alias("q"), F.col("s.block").alias("of"))

    def compare(table: pa.Table) -> pa.Table:
        e, n = flat(table["e"])
        r, q, of = (flat(table[c])[0] for c in ("r", "q", "of"))
        names, u = np.unique(e, return_inverse=True)
        width, norm = len(names), np.zeros(len(names))
        norm[u] = np.sqrt(q)
        norm[norm == 0] = 1e-9
        first, x = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(of == table["block"][0].as_py())
        at = at[np.argsort(u[at], kind="stable")]
        a, starts = np.unique(u[at], return_index=True)
        ends = np.append(starts[1:], len(at))
        work = np.add.reduceat(n[x[at]], starts)
        dense = work.sum() * 32 >= len(a) * width
        parts = []
        for lo, hi in chunks(work, CELLS, max(1, DENSE // width) if dense else 1 << 12):
            these = at[starts[lo] : ends[hi - 1]]
            owner = np.repeat(np.arange(hi - lo), ends[lo:hi] - starts[lo:hi])
            i, b, dot = products(hi - lo, first[x[these]], owner, r[these], n[x[these]], u, r, width)
            sim = dot / (norm[a[lo:hi]][i] * norm[b])
            keep = (a[lo:hi][i] != b) & (sim * 10**digits >= 0.5)
            i, sim, b = best(i[keep], sim[keep], b[keep], width, k, digits)
            parts.append((names[a[lo:hi][i]], names[b], sim))
        return pa.table({c: np.concatenate([p[j] for p in parts]) for j, c in enumerate(("a", "b", "sim"))})

    return sent.groupBy("block").applyInArrow(compare, f"a {kind}, b {kind}, sim double")


#: Rows of a range of users at least, and users of a block that meets all classes of items.
RANGE, USERS = 300_000, 1 << 15


def share(rows: DataFrame) -> int:
    """The rows for a range of users: BLOCKS ranges where the table is large."""
    return max(RANGE, rows.count() // BLOCKS)


def reach(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """((block, e, of, x[], r[], q[]), (block)): for each range of users e, once, the whole lists of all users who share an x with one of its own.

    rows (e, x, r, q) is read twice: give a written table; q may be anything
    that goes with a row. A user's own range is `of`; ranges hold about `limit` rows. Ids that lie near those they share
    with are sent to few ranges, others to all that they meet.
    """
    lists = rows.groupBy("e").agg(F.collect_list(F.struct("x", "r", "q")).alias("s"), F.count(F.lit(1)).alias("n"))
    lists = materialize(lists.select("e", "n", F.col("s.x").alias("x"), F.col("s.r").alias("r"), F.col("s.q").alias("q")), "lists")
    of = materialize(ranges(lists.select("e", "n"), "e", limit).select("e", F.col("block").alias("of")), "blocks")
    met = rows.select("e", "x").join(of, "e").groupBy("x").agg(F.collect_set("of").alias("to"), F.collect_list("e").alias("es"))
    need = materialize(met.select(F.explode("to").alias("block"), "es").select("block", F.explode("es").alias("e")).distinct(), "need")
    return lists.join(of, "e").join(need, "e").select("block", "e", "of", "x", "r", "q"), of.select(F.col("of").alias("block")).distinct()


#: Segments of a block's items at most, and items of a segment at least.
SEGMENTS, SEGMENT = 96, 512


class Reached:
    """One block of `reach` in arrays: users are places in `users`, in ascending order, and items places in `items`; entries lie by user and item."""

    def __init__(self, table: pa.Table, segment: int):
        table = table.sort_by("e")
        self.users = table["e"].to_numpy()
        self.own = np.flatnonzero(table["of"].to_numpy() == table["block"][0].as_py())
        x, self.sizes = flat(table["x"])
        self.items, item = np.unique(x, return_inverse=True)
        user, width = np.repeat(np.arange(len(self.users)), self.sizes), len(self.items)
        key = user * width + item
        by = np.argsort(key, kind="stable")
        key, self.item = key[by], item[by].astype(np.int32)
        self.r = np.nan_to_num(flat(table["r"])[0].astype(float), nan=0.0)[by]
        self.q = flat(table["q"])[0][by]
        self.first = np.cumsum(self.sizes) - self.sizes
        # The same entries by item.
        self.order = np.argsort(self.item, kind="stable")
        self.rater = user[self.order]
        self.raters = np.bincount(self.item, minlength=width)
        self.start = np.cumsum(self.raters) - self.raters
        # Where each user's entries of each segment of items begin.
        self.segments = max(1, min(SEGMENTS, width // segment))
        self.edges = np.linspace(0, width, self.segments + 1).astype(int)
        base = np.arange(len(self.users)) * width
        self.bounds = np.stack([np.searchsorted(key, base + edge) for edge in self.edges])

    def mine(self, user: int) -> slice:
        return slice(self.first[user], self.first[user] + self.sizes[user])


def item_lists(table: pa.Table, k: int, k_nn: int, digits: int, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(user, item, score, rank) of the own users of a block of `reach` with q the sum of squares of x: their k best unrated items.

    A score is the mean of the user's ratings of the k_nn rated items most
    similar to the item, so that it lies between the least and the greatest
    rating of all those that share a user with it. Items are looked at in
    ascending order until k have none but the user's greatest rating, as no
    later one can pass these; only those that the bounds leave in the race are
    scored. All are where a similarity may be 0 or negative.
    """
    at = Reached(table, segment)
    unit, r = 10**digits, at.r
    square = np.zeros(len(at.items))
    square[at.item] = np.nan_to_num(at.q.astype(float), nan=0.0)
    norm = np.where(square > 0, np.sqrt(square), 1e-9)
    sure = len(r) and r.min() > 0 and (r.min() / norm.max()) ** 2 * unit >= 1
    levels, code = np.unique(r, return_inverse=True)
    kind = np.uint8 if len(levels) < 255 else np.int32
    code = (code + 1).astype(kind)
    out = []

    def rounded(v: np.ndarray) -> np.ndarray:
        return np.floor(v * unit + 0.5)

    for user in at.own.tolist():
        own = at.mine(user)
        own = own.start + np.argsort(code[own], kind="stable")
        mine, level = at.item[own], code[own]
        met = spans(at.start[mine], at.raters[mine])
        slot = np.repeat(np.arange(len(mine)), at.raters[mine])
        who = at.rater[met]
        begin = int(np.searchsorted(at.edges, at.item[at.first[who]].min(), side="right")) - 1
        offset, seg, step, pure, parts = at.edges[begin], begin, 1, 0, []
        while seg < at.segments and not (sure and pure >= k):
            to = min(seg + step, at.segments)
            lo, hi = at.edges[seg], at.edges[to]
            there, n = at.bounds[seg][who], at.bounds[to][who]
            n -= there
            there = spans(there, n)
            near = at.item[there] - lo
            codes = np.repeat(level[slot], n)
            seen = mine[(mine >= lo) & (mine < hi)] - lo
            most, least = np.zeros(hi - lo, kind), np.zeros(hi - lo, kind)
            most[near] = codes  # the last, and so the greatest, stays
            least[near[::-1]] = codes[::-1]
            most[seen] = least[seen] = 0
            pure += np.count_nonzero(least == level[-1])
            parts.append((near + lo, there, n, most, least))
            seg, step = to, 2 * step
        most, least = (np.concatenate([p[j] for p in parts]) for j in (3, 4))
        race = most > 0
        if sure:
            above = 0
            for c in np.unique(level)[::-1]:
                same = np.flatnonzero(least == c)
                if above + len(same) >= k:
                    race = most > c
                    last = same[k - above - 1] + 1
                    race[:last] |= most[:last] == c
                    break
                above += len(same)
        cells = []
        for near, there, n, *_ in parts:
            place = np.flatnonzero(race[near - offset])
            if len(place):
                pair = np.searchsorted(np.cumsum(n), place, side="right")
                cells.append((slot[pair], near[place], r[at.order[met[pair]]] * r[there[place]]))
        if not cells:
            continue
        s, c, dot = (np.concatenate([p[j] for p in cells]) for j in range(3))
        cell, back = np.unique(s * len(at.items) + c, return_inverse=True)
        dot = np.bincount(back, dot)
        s, c = cell // len(at.items), cell % len(at.items)
        sim = rounded(dot / (norm[mine[s]] * norm[c]))
        some = sim > 0
        s, c, sim = s[some], c[some], sim[some] / unit
        best_first = np.lexsort((mine[s], -sim, c))
        s, c, sim = s[best_first], c[best_first], sim[best_first]
        heads = np.flatnonzero(np.diff(c, prepend=-1))
        kept = np.arange(len(c)) - np.repeat(heads, np.diff(np.append(heads, len(c)))) < k_nn
        s, c, sim = s[kept], c[kept], sim[kept]
        names, back = np.unique(c, return_inverse=True)
        score = rounded(np.bincount(back, sim * r[own[s]], len(names)) / np.bincount(back, sim, len(names))) / unit
        top = np.lexsort((names, -score))[:k]
        out.append((np.full(len(top), user), names[top], score[top], np.arange(1, len(top) + 1)))
    user, item, score, rank = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, int) for j in range(4))
    return at.users[user], at.items[item], score.astype(float), rank.astype(np.int32)


def summed(owner: np.ndarray, places: np.ndarray, first: np.ndarray, length: np.ndarray, t: np.ndarray, w: np.ndarray, rows: int, width: int) -> np.ndarray:
    """(rows, width): the sums of the vectors (t, w) at the given places, by owner."""
    n = length[places]
    at = spans(first[places], n)
    return np.bincount(np.repeat(owner, n) * width + t[at], w[at], rows * width).reshape(rows, width)


def content_lists(users: pa.Table, classes: pa.Table, k: int, digits: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(user, item, score, rank): the k items nearest to each of users (user_id, n, g[]), the classes of n rated items, by the cosine with the mean of their vectors.

    classes (g, ids[], t[], w[]) holds each vector once, of weights over 0, and
    the k first items that have it. An item of a class that k others precede by
    score and first item can't be among the k best. Users and classes are
    multiplied in chunks of bounded size.
    """
    names = classes["g"].to_numpy()
    (t, length), w, (ids, some) = flat(classes["t"]), flat(classes["w"])[0], flat(classes["ids"])
    width, t = (np.unique(t).size, np.unique(t, return_inverse=True)[1]) if len(t) else (1, t)
    first, head = np.cumsum(length) - length, np.cumsum(some) - some
    things, ids = np.unique(ids, return_inverse=True)
    least = np.minimum.reduceat(ids, head) if len(ids) else ids
    of = np.argsort(least)
    order = np.argsort(names)
    g, n = flat(users["g"])
    place = order[np.searchsorted(names, g, sorter=order)] if len(g) else np.zeros(0, int)
    start, total, user = np.cumsum(n) - n, users["n"].to_numpy(), users["user_id"].to_numpy()
    wide = max(1, (cells << 2) // width)
    held, out, rows = None, [], max(1, min(256, cells // width))
    for lo in range(0, len(user), rows):
        hi = min(lo + rows, len(user))
        owner = np.repeat(np.arange(hi - lo), n[lo:hi])
        profile = summed(owner, place[start[lo] : start[lo] + len(owner)], first, length, t, w, hi - lo, width) / total[lo:hi, None]
        norm = np.sqrt((profile * profile).sum(1))
        norm[norm == 0] = 1
        found = []
        for c in range(0, len(names), wide):
            to = min(c + wide, len(names))
            if held is None or len(names) > wide:
                held = np.ascontiguousarray(summed(np.arange(to - c), np.arange(c, to), first, length, t, w, to - c, width).T)
            s = profile @ held
            s /= norm[:, None]
            bar = np.maximum(np.partition(s, -k, axis=1)[:, -k], 0) - 10.0**-digits if to - c > k else np.zeros(hi - lo)
            row, col = np.divmod(np.flatnonzero((s >= bar[:, None]) & (s > 0)), to - c)
            found.append(best(row, s[row, col], least[col + c], len(things), k, digits))
        row, score, item = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, int) for j in range(3))
        cell = of[np.searchsorted(least, item, sorter=of)] if len(item) else item
        at = spans(head[cell], some[cell])
        row, score, item = best(np.repeat(row, some[cell]), np.repeat(score, some[cell]), ids[at], len(things), k, digits)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row)))) + 1
        out.append((user[row + lo], things[item], score, rank.astype(np.int32)))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(4)) if out else (user, things[:0], np.zeros(0), np.zeros(0, np.int32))


def mixed(mine: np.ndarray, places: np.ndarray, items: np.ndarray, listed: np.ndarray, other: np.ndarray, score: np.ndarray, texts: tuple, k: int, cf_weight: float, content_weight: float, unit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(item, score) of the k best of items with scores over 0, but for a user's own (mine, with their classes), or None where others may be among these."""
    begin, length, t, w, width = texts
    if len(items):
        score = (score - score.min()) / (score.max() - score.min() + 1e-9)
    free = listed & (mine[np.minimum(np.searchsorted(mine, items), len(mine) - 1)] != items)
    items, score, other, places = items[free], score[free], other[free], places[places >= 0]
    terms = spans(begin[places], length[places])
    profile = np.bincount(t[terms], w[terms], width) / len(mine)
    size = math.sqrt((profile * profile).sum())
    text = np.zeros(len(items))
    has = np.flatnonzero(other >= 0)
    if size > 0 and len(has):
        n = length[other[has]]
        terms = spans(begin[other[has]], n)
        text[has] = np.bincount(np.repeat(np.arange(len(has)), n), w[terms] * profile[t[terms]], len(has)) / size
    score = np.floor((cf_weight * score + content_weight * (text + 1) / 2) * unit + 0.5) / unit
    top = np.lexsort((items, -score))[:k]
    return None if len(top) < k or score[top[-1]] <= content_weight + 2 / unit else (items[top], score[top])


def hybrid_lists(table: pa.Table, classes: pa.Table, k: int, k_nn: int, cf_weight: float, content_weight: float, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(user, item, score, rank) of the own users of a block of `reach`: their k best unrated items; rank 0 alone where these can't be told here.

    q is the number of the item's class among classes (number, t[], w[]), -1
    without a vector and -2 where it is no item. An item that no neighbour
    rated has at most content_weight, so that k items of neighbours with more
    are the best of all.
    """
    at, unit = Reached(table, SEGMENT), 10**digits
    numbers, (t, length), w = classes["number"].to_numpy(), flat(classes["t"]), flat(classes["w"])[0]
    order = np.argsort(numbers)
    begin, length = (np.cumsum(length) - length)[order], length[order]
    numbers, width = numbers[order], int(t.max(initial=0)) + 1
    vector = np.searchsorted(numbers, at.q)
    vector[(at.q < 0) | (vector == len(numbers))] = -1
    r, square = at.r, np.bincount(np.repeat(np.arange(len(at.users)), at.sizes), at.r * at.r, len(at.users))
    norm = np.where(square > 0, np.sqrt(square), 1e-9)
    out = []
    for user in at.own.tolist():
        own = at.mine(user)
        mine, places = at.item[own], vector[own]
        met = spans(at.start[mine], at.raters[mine])
        near, back = np.unique(at.rater[met], return_inverse=True)
        dot = np.bincount(back, np.repeat(r[own], at.raters[mine]) * r[at.order[met]])
        sim = np.floor(dot / (norm[user] * norm[near]) * unit + 0.5)
        sim[near == user] = 0
        best_first = np.lexsort((near, -sim))[:k_nn]
        best_first = best_first[sim[best_first] > 0]
        near, sim = near[best_first], sim[best_first] / unit
        theirs = spans(at.first[near], at.sizes[near])
        items, one, back = np.unique(at.item[theirs], return_index=True, return_inverse=True)
        sim = np.repeat(sim, at.sizes[near])
        score = np.bincount(back, sim * r[theirs], len(items)) / np.bincount(back, sim, len(items))
        one, items, score = theirs[one[score > 0]], items[score > 0], score[score > 0]
        top = mixed(mine, places, items, at.q[one] > -2, vector[one], score, (begin, length, t, w, width), k, cf_weight, content_weight, unit)
        if top is None:
            out.append((np.array([user]), np.zeros(1, int), np.zeros(1), np.zeros(1, int)))
        else:
            out.append((np.full(k, user), *top, np.arange(1, k + 1)))
    user, item, score, rank = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, int) for j in range(4))
    return at.users[user], at.items[item], score.astype(float), rank.astype(np.int32)
