"""Whitening against a dense eigendecomposition of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from mnemospark.llm import whitening
from mnemospark.llm.common import ready
from mnemospark.llm.queries import QUERIES


def rows(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    data = [(i, v, 1, "z") for i, v in zip(ids, vectors)]
    return ready(spark).createDataFrame(data, "vec_id long, embedding array<float>, label int, part string").repartition(7)


def whole(vectors):
    return np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int)


def whitened(df):
    found, dimension = whitening.usable(df)
    model = whitening.fit(found, dimension)
    return model, {r["vec_id"]: r for r in whitening.whiten(found, model).collect()}


def test_components_and_exact_deviations(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(700, 40)) @ rng.normal(size=(40, 40)) * 0.2 + 3).tolist()
    model, got = whitened(rows(spark, vectors))
    x = whole(vectors)
    apart = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(apart.T @ apart / len(x))
    values, basis = values[::-1][:32], basis[:, ::-1][:, :32]
    assert model.eigenvalues == pytest.approx(values, rel=1e-12)
    assert np.abs(np.abs((basis * model.components).sum(axis=0)) - 1).max() < 1e-12
    assert model.explained == pytest.approx(values / np.trace(apart.T @ apart / len(x)), rel=1e-12)
    assert model.identity_error < 1e-10
    signs = np.sign((basis * model.components).sum(axis=0))
    want = apart @ basis / np.sqrt(values) * signs
    sums, n = x.sum(axis=0).tolist(), len(x)
    for k in range(n):
        assert got[k]["whitened"] == pytest.approx(want[k], abs=1e-9)
        assert got[k]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[k].tolist(), sums))


def test_rows_that_do_not_count(spark):
    fine = np.random.default_rng(1).normal(size=(30, 3)).tolist()
    bad = [None, [1.0, None, 2.0], [1.0, math.nan, 0.0], [math.inf, 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0], []]
    ids = [*range(29), None, *range(100, 107)]
    model, got = whitened(rows(spark, fine + bad, ids))
    assert set(got) == {*range(29), None} and model.n == 30
    assert len(got[0]["whitened"]) == 3
    found, dimension = whitening.usable(rows(spark, [None, []]))
    assert dimension == 0 and whitening.fit(found, dimension) is None
    assert whitening.usable(rows(spark, [[1.0], [2.0, 3.0]]))[1] == 2


def test_directions_without_variance(spark):
    base = np.random.default_rng(2).normal(size=(50, 2))
    vectors = np.hstack([base, base[:, :1], np.full((50, 2), 9.0)])[[*range(50), *[7] * 60]].tolist()
    model, got = whitened(rows(spark, vectors))
    assert model.n == 110 and model.identity_error < 1e-9
    assert all([v is None for v in r["whitened"]] == [False, False, True, True, True] for r in got.values())
    alone, one = whitened(rows(spark, [[1.0, 2.0]]))
    assert one[0]["whitened"] == [None, None] and one[0]["deviation"] == 0 and alone.identity_error is None


def test_deviation_beyond_a_long(spark):
    vectors = [[2.0**40, 0.0], [-(2.0**40), 0.0], [0.0, 1.0]]
    _, got = whitened(rows(spark, vectors))
    assert got[0]["deviation"] is None and got[2]["deviation"] == 128**2


def test_rank_one_updates_of_repeated_eigenvalues():
    rng = np.random.default_rng(5)
    for size in (1, 2, 5, 12):
        for _ in range(60):
            values = np.sort(rng.choice([0.0, 1.0, 1.0 + 1e-15, 4.0, 1e6], size))
            basis = np.linalg.qr(rng.normal(size=(size, size)))[0]
            v = rng.normal(size=size) * rng.choice([0.0, 1e-9, 1.0, 1e3])
            rho = float(rng.choice([0.5, 1e-6, 7.0]))
            new, vectors = whitening.rank_one(values, basis, v, rho)
            dense = (basis * values) @ basis.T + rho * np.outer(v, v)
            scale = max(np.abs(dense).max(), 1e-300)
            assert (np.diff(new) >= 0).all()
            assert np.abs((vectors * new) @ vectors.T - dense).max() < 1e-13 * size * scale
            assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13 * size


def test_merged_spectra_equal_the_whole():
    x = np.random.default_rng(6).integers(-40, 40, size=(90, 6))
    parts = []
    for part in (x[:0], x[:1], x[1:50], x[50:]):
        spectrum = whitening.Spectrum.empty(6)
        spectrum.add(part)
        parts.append(spectrum)
    whole_one = parts[0]
    for part in parts[1:]:
        whole_one = whole_one.merged(part)
    apart = x - x.mean(axis=0)
    assert whole_one.n == 90 and whole_one.sums == x.sum(axis=0).tolist()
    assert (whole_one.vectors * whole_one.values) @ whole_one.vectors.T == pytest.approx(apart.T @ apart, abs=1e-8)


def test_query(spark):
    out = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    assert len(out) == 32 * len(vectors) and set(out["component"]) == set(range(1, 33))
    x = whole(np.stack(vectors["embedding"]))
    n, sums = len(x), [Fraction(int(s)) for s in x.sum(axis=0)]
    want = {i: int(sum((n * Fraction(int(a)) - s) ** 2 for a, s in zip(r, sums))) for i, r in zip(vectors["vec_id"], x)}
    assert dict(zip(out["vec_id"], out["deviation"])) == want
    assert out["identity_error"].max() <= 1e-4 and not out["whitened"].isna().any()
