"""Whitening against exact fractions and long doubles, and on odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from assaylake.llm import whitening as wh


def frame(spark, x, ids=None, kind="float"):
    return spark.createDataFrame(list(zip(ids or range(len(x)), x)), f"vec_id long, embedding array<{kind}>")


def exact_covariance(x):
    n, total = len(x), [sum(int(v) for v in column) for column in x.T]
    centred = [[Fraction(int(v)) - Fraction(s, n) for v, s in zip(row, total)] for row in x]
    return [[sum(r[i] * r[j] for r in centred) / n for j in range(x.shape[1])] for i in range(x.shape[1])], total


def test_covariance_is_exact_to_twice_a_double(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, size=(301, 5)) + 10**9  # centring loses all but a few bits of a plain product
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, x array<long>").repartition(6)
    want, total = exact_covariance(x)
    assert wh.sums(rows) == (301, total)
    high, low = wh.covariance(rows, "x", 5, 301, *wh.mean(301, total))
    for i in range(5):
        for j in range(5):
            got = Fraction(float(high[i, j])) + Fraction(float(low[i, j]))
            assert abs(got - want[i][j]) <= abs(want[i][i]) * Fraction(1, 2**95)


def test_error_free_parts():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=50) * 1e9, rng.normal(size=50)
    total, left = wh.two_sum(a, b)
    assert all(Fraction(x) + Fraction(y) == Fraction(t) + Fraction(e) for x, y, t, e in zip(a, b, total, left))


@pytest.mark.parametrize("width", [1, 3, 8, 20])
def test_against_numpy(spark, width):
    rng = np.random.default_rng(width)
    vectors = (rng.normal(size=(200, width)) * np.linspace(0.02, 0.3, width)).astype(np.float32)
    got = wh.whiten(frame(spark, vectors.tolist())).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(vectors.astype(float) * 1024).astype(np.int64) + 100_000
    n, k, total = len(x), min(width, 8), x.sum(0)
    centred = ((n * x - total) / n).astype(np.longdouble)
    cov = (centred.T @ centred / n).astype(float)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    white = got["whitened"].to_numpy().reshape(n, k)
    want = centred.astype(float) @ basis / np.sqrt(values)
    assert np.allclose(white, want * np.sign((white * want).sum(0)), atol=1e-8)
    assert np.allclose(got["explained"].to_numpy()[:k], values / np.trace(cov), rtol=1e-9)
    assert (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    assert [int(d) for d in got["deviation"][::k]] == ((n * x - total) ** 2).sum(1).tolist()


def test_whitened_has_the_identity_as_covariance(spark):
    rng = np.random.default_rng(12)
    mixed = rng.normal(size=(500, 12)) @ rng.normal(size=(12, 12))
    white = wh.whiten(frame(spark, mixed.tolist())).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-10


def test_components_without_variance(spark):
    x = [[1.0, 2.0, 0.5], [2.0, 4.0, 0.5], [4.0, 8.0, 0.5]]
    got = wh.whiten(frame(spark, x)).orderBy("vec_id", "component").collect()
    assert len(got) == 9 and got[0]["whitened"] is not None and got[1]["whitened"] is None and got[2]["whitened"] is None
    assert got[0]["explained"] == pytest.approx(1) and got[2]["explained"] == 0 and got[0]["identity_error"] < 1e-10
    same = wh.whiten(frame(spark, [[1.0, 1.0]] * 3)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1, 0.9], [0.7, 0.2], [0.5, 0.5]]
    x = [*good, None, [], [1.0, None], [nan, 1.0], [1.0, inf], [1.0], good[0], good[0]]
    ids = [2**60 + 1, None, 3, 4, 5, 6, 7, 8, 9, 3, 3]
    got = wh.whiten(frame(spark, x, ids)).toPandas()
    assert (got["n"] == 5).all() and len(got) == 10
    assert sorted(r["vec_id"] or 0 for r in wh.whiten(frame(spark, x, ids)).where("component = 1").collect()) == [0, 3, 3, 3, 2**60 + 1]
    clash = spark.createDataFrame([(1, [0.5, 1.0], 1, 1), (2, [1.0, 0.25], 1, 1)], "vec_id long, embedding array<double>, x int, component int")
    assert wh.whiten(clash).count() == 4
    with pytest.raises(ValueError):
        wh.whiten(frame(spark, [[1e30, 1.0], [1.0, 1.0]]))


def test_one_vector_and_none(spark):
    assert [r["whitened"] for r in wh.whiten(frame(spark, [[1.0, 2.0]])).collect()] == [None, None]
    assert wh.whiten(frame(spark, [], [])).count() == 0 and wh.whiten(frame(spark, [None])).count() == 0


def test_deviations_stay_exact_beyond_64_bits():
    x = np.array([[10**14, -(10**14)], [3, 4]])
    n, total = 10**7, [5, 7]
    assert wh.deviations(x, n, total) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]


def test_wide_vectors_and_layouts(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 300)).astype(np.float32).tolist()
    one, other = (wh.whiten(frame(spark, x).repartition(p)).toPandas().sort_values(["vec_id", "component"]) for p in (1, 7))
    assert np.allclose(one["whitened"], other["whitened"], atol=1e-9) and len(one) == 320
