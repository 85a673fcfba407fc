"""Whitened vectors against a dense decomposition of the whole covariance."""

import numpy as np
import pytest

from zoneflow.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string"


def dense(vectors, k):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(np.float64)) + 100_000
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(c))
    values, axes = values[::-1], axes[:, ::-1][:, :k]
    return x, c @ axes / np.sqrt(values[:k]), values


@pytest.mark.parametrize(("rows", "width"), [(400, 12), (300, 5), (900, 30)])
def test_against_a_dense_decomposition(spark, rows, width):
    rng = np.random.default_rng(rows)
    vectors = (rng.standard_normal((rows, width)) * np.linspace(1, 3, width)).astype(np.float32)
    odd = [
        (None, [float("nan")] * width, "x"), (1, None, "x"), (2, [], "x"), (3, [1.0] * (width - 1), "x"),
        (4, [None] + [1.0] * (width - 1), "x"), (5, [float("inf")] * width, "x"), (6, [3e38] * width, "x"),
    ]
    table = spark.createDataFrame([(1000 + i, v.tolist(), "x") for i, v in enumerate(vectors)] + odd, SCHEMA)
    got = whitening.whiten(table.repartition(3)).orderBy("vec_id", "component").collect()
    k = min(8, width)
    x, white, values = dense(vectors, k)
    assert [(r.vec_id, r.component) for r in got] == [(1000 + i, j + 1) for i in range(rows) for j in range(k)]
    found = np.array([r.whitened for r in got]).reshape(rows, k)
    sign = np.sign((found * white).sum(axis=0))
    assert np.abs(found * sign - white).max() < 1e-10
    assert np.allclose([r.explained for r in got[:k]], values[:k] / values.sum(), rtol=1e-12)
    assert {r.identity_error for r in got}.pop() < 1e-12 and {r.n for r in got} == {rows}
    whole, sums = x.astype(object), x.sum(axis=0).astype(object)
    for i in (0, rows - 1):
        exact = sum((rows * int(a) - int(s)) ** 2 for a, s in zip(whole[i], sums, strict=True))
        assert got[i * k].deviation == exact


def test_few_rows_equal_rows_and_none(spark):
    three = [(1, [1.0, 0.0, 0.0, 2.0], "x"), (1, [0.0, 1.0, 0.0, 2.0], "x"), (None, [0.0, 0.0, 1.0, 2.0], "x")]
    got = whitening.whiten(spark.createDataFrame(three, SCHEMA)).collect()
    assert sorted({r.component for r in got}) == [1, 2] and len(got) == 6
    assert sum(r.vec_id is None for r in got) == 2 and got[0].identity_error < 1e-9
    same = spark.createDataFrame([(i, [0.5, 0.25], "x") for i in range(9)], SCHEMA)
    for table in (same, same.limit(1), same.limit(0), same.selectExpr("vec_id", "NULL AS embedding", "n")):
        assert whitening.whiten(table).collect() == []


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float(2.0**45 * i), 1.0], "x") for i in range(4)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert [r.deviation for r in whitening.whiten(table).where("component = 1").collect()] == [None] * 4
    mid = [(i, [float(2.0**18 * i), 1.0], "x") for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(mid, SCHEMA)).where("component = 1").orderBy("vec_id").collect()
    assert [r.deviation for r in got] == [(4 * (i << 28) - (6 << 28)) ** 2 if (4 * i - 6) ** 2 << 56 < 1 << 63 else None for i in range(4)]


def test_jacobi_davidson_on_a_large_clustered_spectrum():
    """Far more dimensions than the search space holds; close and equal eigenvalues."""
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.standard_normal((500, 500)))[0]
    values = np.concatenate([[9, 9, 5, 4.99], 4 + rng.random(60) * 0.9, rng.random(436)])
    matrix = (axes * values) @ axes.T
    products = []

    def multiply(x):
        products.append(x.shape[1])
        return matrix @ x

    found, vectors = whitening.jacobi_davidson(multiply, 500, 8)
    assert np.allclose(found, np.sort(values)[::-1][:8], rtol=1e-12)
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12 and len(products) < 400
