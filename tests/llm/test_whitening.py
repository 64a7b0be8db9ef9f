import math
from fractions import Fraction

import numpy as np
import pytest

from voxloom.llm import queries, whitening


def whole(vectors):
    return [[math.floor(1024 * Fraction(c)) + 100_000 for c in v] for v in vectors]


def exact(x):
    """(sums, n^2 times the covariance) in Python's integers."""
    n, d = len(x), len(x[0])
    sums = [sum(v[k] for v in x) for k in range(d)]
    y = [[n * v[k] - sums[k] for k in range(d)] for v in x]
    return sums, [[sum(r[i] * r[j] for r in y) // n for j in range(d)] for i in range(d)], y


@pytest.mark.parametrize("size, top", [(3, 10), (5, 2**19), (4, 2**40), (2, 2**53)])
def test_products_are_exact(size, top):
    rng = np.random.default_rng(size)
    z = rng.integers(-top, top + 1, (whitening.ROWS + 77, size))
    rows = [[int(v) for v in r] for r in z]
    want = [[sum(r[i] * r[j] for r in rows) for j in range(size)] for i in range(size)]
    assert whitening.gram(z).tolist() == want
    assert [whitening.joined(whitening.split(int(v))) for v in whitening.gram(z).ravel()] == sum(want, [])
    assert whitening.squares(z).tolist() == [sum(v * v for v in r) for r in rows]
    assert sum(c * 2.0 ** (whitening.BITS * k) for k, c in enumerate(whitening.limbs(z[:50]))).tolist() == z[:50].astype(float).tolist()


def test_big_totals_survive_their_digits():
    for v in (0, 1, -1, 2**159 - 1, -(2**159), 12345678901234567890123, -98765432109876543210):
        assert whitening.joined(whitening.split(v)) == v


def test_rows_against_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 5)) @ np.diag([1000.0, 30, 1, 0.1, 0.02]) + 5e3  # a large mean would cancel in float64
    good = [[float(np.float32(c)) for c in v] for v in base]
    rows = [(i, v) for i, v in enumerate(good)] + [(7, good[7]), (None, good[3])]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS component", "'x' AS whitened").repartition(5)
    got = whitening.whitened(df, components=4).collect()
    assert len(got) == 4 * len(rows)
    x = whole([v for _, v in rows])
    sums, scaled, y = exact(x)
    n = len(x)
    v = np.array([[c / n**2 for c in r] for r in scaled])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-8
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-9)
    for (key, _), xs, ys in zip(rows, x, y, strict=True):
        p = np.array([c / n for c in ys]) @ axes / np.sqrt(e)
        for k in range(1, 5):
            assert int(by[key, k][0]["deviation"]) == sum(c * c for c in ys)
            assert abs(by[key, k][0]["whitened"]) == pytest.approx(abs(p[k - 1]), rel=1e-6, abs=1e-7)
    assert len(by[7, 1]) == 2 and len(by[None, 2]) == 1
    w = np.array([[by[i, k][0]["whitened"] for k in range(1, 5)] for i in range(60)])
    signs = [np.sign(w[0, k] * (np.array([c / n for c in y[0]]) @ axes)[k]) for k in range(4)]
    assert np.allclose(w * signs, np.array([[c / n for c in r] for r in y[:60]]) @ axes[:, :4] / np.sqrt(e[:4]), rtol=1e-5, atol=1e-6)


def test_extremes(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert make([]).collect() == [] and make([(1, None)]).collect() == []
    one = make([(1, [1.0, 2.0])]).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, "0", None, 0.0, 0.0), (2, "0", None, 0.0, 0.0)]
    huge = make([(k, [1e300 * (-1) ** k, float(k)]) for k in range(8)]).collect()
    assert {r["component"] for r in huge} == {1, 2} and all(r["whitened"] is None or math.isfinite(r["whitened"]) for r in huge)
    big = 2**52 + 100_000
    assert int(huge[0]["deviation"]) >= (8 * big - 8 * 100_000) ** 2


def test_query_on_the_whole_table(spark, sf):
    rows = queries.op11_whitening(spark, sf).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    x = np.array(whole(vectors.values()), object)
    n, sums = len(x), x.sum(axis=0)
    deviations = dict(zip(vectors, ((n * x - sums) ** 2).sum(axis=1), strict=True))
    assert len(rows) == 8 * n and all(r["deviation"] == deviations[r["vec_id"]] for r in rows)
    w = np.zeros((n, 8))
    at = {k: i for i, k in enumerate(vectors)}
    for r in rows:
        w[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9 and rows[0]["identity_error"] < 1e-9
    v = np.cov(x.astype(float).T, bias=True)
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert {r["component"]: r["explained"] for r in rows} == pytest.approx({k + 1: e[k] / e.sum() for k in range(8)}, rel=1e-9)
