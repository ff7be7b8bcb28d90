"""Whitening against numpy's SVD of the centred rows, with dependent and odd vectors."""

import numpy as np
import pytest

from bidlake.llm import whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")


def against_svd(df, k):
    rows, _ = whitening.usable(df)
    src = [(r["vec_id"], r["v"]) for r in rows.collect()]
    x = np.floor(np.array([v for _, v in src], np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    _, sigma, vt = np.linalg.svd(y, full_matrices=False)
    e = sigma**2 / n
    got = whitening.whiten(df).toPandas()
    assert len(got) == n * k
    assert (got["n"] == n).all() and got["identity_error"].max() < 1e-9
    deviation = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for (i, _), row in zip(src, x, strict=True)}
    assert all(deviation[i] == d for i, d in zip(got["vec_id"], got["deviation"], strict=True))
    ids = np.array([i for i, _ in src])
    for c in range(1, k + 1):
        some = got[got["component"] == c].sort_values("vec_id")
        want = (y @ vt[c - 1] / np.sqrt(e[c - 1]))[np.argsort(ids, kind="stable")]
        have = some["whitened"].to_numpy()
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert np.allclose(some["explained"], e[c - 1] / e.sum(), rtol=1e-9)


def test_given_vectors(spark, sf_dir):
    against_svd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8)


@pytest.mark.parametrize("n", [150, 4, 2])
def test_dependent_dimensions(spark, n):
    """Repeated, scaled and constant dimensions, fewer rows than dimensions, tiny variances."""
    b = np.random.default_rng(4).normal(size=(n, 5)).astype(np.float32)
    rows = np.column_stack([b, b[:, 0], np.ones(n), b[:, 1], b[:, 2] * 100])
    against_svd(vectors(spark, rows), min(n - 1, 6))


def test_hot_vector(spark):
    """A third and more of all rows are one vector."""
    r = np.random.default_rng(5)
    against_svd(vectors(spark, [*r.normal(size=(200, 12)), *[r.normal(size=12)] * 150]), 8)


def test_passes_to_orthonormal_rows(spark):
    """Ill conditioned rows take another pass, and the factor is that of numpy's QR."""
    r = np.random.default_rng(6)
    b = r.normal(size=(300, 1))
    rows = vectors(spark, 5000 * b + r.normal(size=(300, 6)) * [3, 1, 0.3, 0.1, 0.03, 0.01])
    got, d = whitening.usable(rows)
    n, s = whitening.sums(got, d)
    factor, passes = whitening.factor(got, d, n, s)
    x = np.floor(np.array([v["v"] for v in got.collect()], np.float64) * 1024).astype(np.int64) + 100_000
    a = (n * x - s.astype(np.int64)) / n
    want = np.linalg.qr(a, mode="r")
    assert passes >= 3 and np.allclose(np.abs(factor), np.abs(want), rtol=1e-7, atol=1e-6 * np.abs(want).max() / 1e6)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, nan]), (2, None), (3, []), (4, [1.0, None]), (None, [1.0, 2.0]), (5, [2.0, 2.0]), (5, [2.0, 2.0]), (6, [3.0, 1.0]), (7, [1e30, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, v string")
    got = whitening.whiten(df).toPandas()
    assert sorted(got["vec_id"].fillna(-1).tolist()) == sorted([-1, 5, 5, 6] * (len(got) // 4)) and set(got["n"]) == {4}
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whiten(vectors(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.whiten(vectors(spark, [[], []])).count() == 0


def test_deviation_beyond_a_long(spark):
    """Exact up to the largest long, null beyond."""
    big = vectors(spark, [[2.0**29], [-(2.0**29)], [0.0], [0.0]])
    assert {r["deviation"] for r in whitening.whiten(big).collect()} == {None, 0}
