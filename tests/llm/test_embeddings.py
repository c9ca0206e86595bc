"""Recall of the filters on planted pairs among many vectors."""

import numpy as np

from minewright.llm import embedding_dedup


def planted(n, pairs, dim=64, seed=4):
    """n random vectors, then `pairs` near 0.9 to 0.95 of the first ones, then as many at 0.899."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = x[: 2 * pairs]
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = np.concatenate([np.linspace(0.9001, 0.95, pairs), np.full(pairs, 0.899)])[:, None]
    return np.concatenate([x, cosine * base + np.sqrt(1 - cosine**2) * side])


def test_planted_pairs_are_found(spark):
    n, pairs = 20000, 400
    x = planted(n, pairs)
    spark_rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark_rows).collect()}
    assert len(got) == len(x)
    found = [got[n + i] == (1, i) and got[i] == (1, i) for i in range(pairs)]
    assert np.mean(found) >= 0.95
    linked = {i for i, (k, _) in got.items() if k}
    assert linked <= set(range(pairs)) | set(range(n, n + pairs))
