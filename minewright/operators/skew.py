"""Joins to a table with one row for each key, some of whose keys hold a large part of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than this share of the rows count as hot; there are fewer than its inverse.
SHARE = 1e-3


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """left joined (inner or left) to right, whose `count` says how many rows of left each key has.

    At most 1 / SHARE keys can hold more than SHARE of the `total` rows each:
    so many hashes of keys come to the driver, and their rows of right are
    broadcast, so that no task receives a hot key. The others are shuffled.
    Both sides are read twice: give written tables.
    """
    code = F.xxhash64(*keys)
    hot = [r["h"] for r in right.where(F.col(count) > max(1.0, SHARE * total)).select(code.alias("h")).distinct().collect()]
    if not hot:
        return left.join(right, keys, how)
    # Both sides are split by the same test, so that a key with a hot key's hash goes with it.
    is_hot = code.isin(hot)
    some = left.where(is_hot).join(F.broadcast(right.where(is_hot)), keys, how)
    return some.unionByName(left.where(~is_hot).join(right.where(~is_hot), keys, how))
