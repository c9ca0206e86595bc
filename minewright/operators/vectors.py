"""Exact comparison of all vectors with all, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 2048


def stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from differences, so that equal vectors have distance 0."""
    out = np.empty((len(a), len(b)))
    for lo in range(0, len(a), 64):
        d = a[lo : lo + 64, None, :] - b[None, :, :]
        out[lo : lo + 64] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def quick_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from products; those of near vectors, which products blur, from differences."""
    p, q = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    out = a @ b.T
    out *= -2
    out += p[:, None]
    out += q
    i, j = np.nonzero(~(out > 1e-4 * (p.max(initial=0) + q.max(initial=0))))
    np.sqrt(np.maximum(out, 0, out=out), out=out)
    for lo in range(0, len(i), 1 << 16):
        x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        d = a[x] - b[y]
        out[x, y] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def compare_all(df: DataFrame, key: str, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, rows: int, tile: int = TILE) -> DataFrame:
    """f(left block, right block) for every pair of blocks of df (columns key, v and others).

    Blocks hold about `tile` rows whatever the table's size; `rows` is the
    number of rows of df. A task holds one pair of blocks.
    """
    n = max(1, -(-rows // tile))
    tiled = df.withColumn("_t", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = tiled.withColumn("_o", spread).select("*", F.col("_t").alias("_l"), F.col("_o").alias("_r"), F.lit(True).alias("_a")).drop("_t", "_o")
    right = tiled.withColumn("_o", spread).select("*", F.col("_o").alias("_l"), F.col("_t").alias("_r"), F.lit(False).alias("_a")).drop("_t", "_o")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf[pdf["_a"]].reset_index(drop=True), pdf[~pdf["_a"]].reset_index(drop=True))

    return left.unionByName(right).groupBy("_l", "_r").applyInPandas(block, schema)
