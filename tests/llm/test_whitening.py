"""Chebyshev-filtered subspace iteration against dense eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.llm import whitening

VEC = "vec_id long, embedding array<float>"


def dense(vectors, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((n * x - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviation = [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]
    return values, centred @ axes / np.sqrt(values), deviation, float((centred**2).sum() / n)


def by_component(rows):
    ids = sorted({r["vec_id"] for r in rows})
    n = max(r["component"] for r in rows)
    white = np.zeros((len(ids), n))
    for r in rows:
        white[ids.index(r["vec_id"]), r["component"] - 1] = r["whitened"]
    return white


@pytest.mark.parametrize("width, k", [(5, 32), (40, 8), (70, 32)])
def test_report_equals_dense_eigenvectors(spark, width, k):
    rng = np.random.default_rng(width)
    vectors = rng.standard_normal((400, width)) @ np.diag(np.linspace(3, 0.5, width)) + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VEC).repartition(3)
    rows = whitening.whitening_report(df, k).collect()
    k = min(k, width)
    values, want, deviation, trace = dense(vectors, k)
    white = by_component(rows)
    assert white.shape == (400, k) and len(rows) == 400 * k
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white * signs - want).max() < 1e-8
    for r in rows:
        assert r["n"] == 400 and r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] / (values[r["component"] - 1] / trace) - 1) < 1e-10
        assert r["identity_error"] < 1e-10


def test_close_eigenvalues_are_parted(spark):
    """A nearly flat spectrum, as of the given embeddings; the block is smaller than the space."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((3000, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VEC)
    fit = whitening.fit_whitening(df, 10, guard=8)
    values, _, _, trace = dense(vectors, 10)
    assert np.abs(fit.values / values - 1).max() < 1e-11 and fit.residual <= 1e-12
    assert np.abs(fit.vectors.T @ fit.vectors - np.eye(10)).max() < 1e-12 and abs(fit.trace / trace - 1) < 1e-11
    assert fit.passes > 10


def test_odd_rows(spark):
    """Nulls, null and non-finite entries, huge entries, other lengths, no vector, repeated rows and ids, clashing columns."""
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 0.5]), (None, [0.0, 1.0]), (4, [-0.01, 0.0])]
    bad = [(5, None), (6, []), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1e30, 1.0]), (11, [1.0, 2.0, 3.0])]
    names = "block ids rows i n total deviation whitened component"
    df = spark.createDataFrame(good + bad, VEC).select("*", *[F.lit("kept").alias(x) for x in names.split()])
    rows = whitening.whitening_report(df).collect()
    values, want, deviation, _ = dense([v for _, v in good], 2)
    assert len(rows) == 10 and {r["n"] for r in rows} == {5}
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in rows if r["component"] == 1) == sorted(
        (str(i), d) for (i, _), d in zip(good, deviation)
    )
    assert all(abs(sum(r["whitened"] for r in rows if r["component"] == c)) < 1e-9 for c in (1, 2))


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitening_report(spark.createDataFrame(rows, VEC)).collect() == []


def test_components_end_where_the_variance_does(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.standard_normal((200, 3)) * 64) @ np.round(rng.standard_normal((3, 60)) * 8) / 64
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VEC)
    rows = whitening.whitening_report(df).collect()
    assert len(rows) == 600 and rows[0]["identity_error"] < 1e-8


def test_deviations_are_exact_beyond_double(spark):
    rows = np.array([[10**9, -5], [3, 7]], np.int64)
    n, sums = 3_000_000, (12345, 678)
    assert whitening.deviations(rows, n, sums) == [None, (3 * n - 12345) ** 2 + (7 * n - 678) ** 2]


def test_vectors_of_doubles_and_text_ids(spark):
    rng = np.random.default_rng(6)
    data = [(f"v{i}", v.tolist()) for i, v in enumerate(rng.standard_normal((50, 6)))]
    df = spark.createDataFrame(data, "vec_id string, embedding array<double>")
    fit = whitening.fit_whitening(df, 2)
    white = {r["vec_id"]: r["whitened"] for r in whitening.whiten(fit).collect()}
    assert set(white) == {i for i, _ in data} and whitening.identity_error(fit) < 1e-10
    assert np.abs(np.cov(np.array(list(white.values())).T, bias=True) - np.eye(2)).max() < 1e-10
