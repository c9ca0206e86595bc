"""PCA and SVD through the d by d Gram matrix, which is summed on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.operators.clustering import standardise
from minewright.operators.vectors import stack
from minewright.runtime import ship_package


def covariance(df: DataFrame) -> DataFrame:
    """(i, j, value) for i <= j of Z'Z / (n - 1), Z standardised."""
    ship_package(df.sparkSession)
    n = df.count()
    return _gram(standardise(df)).where("i <= j").select("i", "j", (F.col("x") / max(n - 1, 1)).alias("value"))


def _gram(df: DataFrame) -> DataFrame:
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = stack(batch["v"])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel().astype("int32"), "j": j.ravel().astype("int32"), "x": total.ravel()})

    return df.select("v").mapInPandas(partial, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))


def _eigen(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and vectors (columns) of v'v; signs make each vector's largest entry positive."""
    rows = _gram(df).toPandas()
    d = int(rows["i"].max()) + 1 if len(rows) else 0
    gram = np.zeros((d, d))
    gram[rows["i"], rows["j"]] = rows["x"]
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if d:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(d)])
    return values, vectors


def project(df: DataFrame, weights: np.ndarray) -> DataFrame:
    ship_package(df.sparkSession)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "v": list(stack(batch["v"]) @ weights)})

    return df.select("id", "v").mapInPandas(apply, "id long, v array<double>")


class Pca:
    """Components that explain `threshold` of the variance of standardised features."""

    def __init__(self, threshold: float = 0.9):
        self.threshold = threshold

    def fit(self, df: DataFrame) -> Pca:
        ship_package(df.sparkSession)
        values, self.vectors = _eigen(standardise(df))
        self.variances = values / max(df.count() - 1, 1)
        self.ratios = values / values.sum() if values.sum() else values
        self.k = int(np.argmax(np.cumsum(self.ratios) >= self.threshold - 1e-12)) + 1
        return self

    def transform(self, df: DataFrame, k: int | None = None) -> DataFrame:
        """Scores of df by its own scaling."""
        return project(standardise(df), self.vectors[:, : k or self.k])

    def loadings(self, names: list[str], n: int = 5) -> list[list[tuple[str, float]]]:
        """Per component the n features of greatest absolute weight."""
        return [[(names[i], float(w[i])) for i in np.argsort(-np.abs(w), kind="stable")[:n]] for w in self.vectors[:, : self.k].T]


class Svd:
    """Thin SVD of the rows v: singular values, right vectors, projections U S."""

    def fit(self, df: DataFrame) -> Svd:
        ship_package(df.sparkSession)
        values, self.vectors = _eigen(df)
        self.singular = np.sqrt(values)
        return self

    def transform(self, df: DataFrame, k: int) -> DataFrame:
        return project(df, self.vectors[:, :k])

    def reconstruct(self, df: DataFrame, k: int) -> DataFrame:
        return project(df, self.vectors[:, :k] @ self.vectors[:, :k].T)

    def errors(self, ks: list[int]) -> list[tuple[int, float]]:
        """(k, relative Frobenius error), from the singular values alone."""
        squares = self.singular**2
        return [(k, float(np.sqrt(max(0.0, 1 - squares[:k].sum() / squares.sum())))) for k in ks]
