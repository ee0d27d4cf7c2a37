from fractions import Fraction

import numpy as np
import pytest

from barloom.llm import whitening
from barloom.llm.queries import QUERIES


def brute(rows, count=8):
    """(vec_id, component) -> n, deviation, whitened, explained; by exact fractions and the library's eigenvectors."""
    x = [(i, [int(np.floor(1024 * float(c))) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, dims = len(x), len(x[0][1])
    sums = [sum(v[k] for _, v in x) for k in range(dims)]
    away = np.array([[n * v[k] - sums[k] for k in range(dims)] for _, v in x], object)
    exact = np.array([[Fraction(int(e), n**4) for e in row] for row in away.T @ away * n], object)
    covariance = exact.astype(np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    y = (away / n).astype(np.float64) @ vectors / np.sqrt(values)
    return [(i, k + 1, n, int((away[r] ** 2).sum()), y[r, k], values[k] / np.trace(covariance)) for r, (i, _) in enumerate(x) for k in range(len(values))]


def check(got, want, tol=1e-7):
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want]
    signs = {}
    for r in want:
        k = r[1]
        if k not in signs or abs(r[4]) > abs(signs[k][0]):
            signs[k] = (r[4], next(g[4] for g in got if g[0] == r[0] and g[1] == k))
    for g, r in zip(got, want, strict=True):
        sign = np.sign(signs[r[1]][0] * signs[r[1]][1])
        assert g[2:4] == r[2:4] and abs(sign * g[4] - r[4]) <= tol and abs(g[5] / r[5] - 1) < 1e-9
        assert g[6] <= 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_whitening"](spark, d).collect())
    check(got, sorted(brute(rows)))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    for spectrum in (rng.standard_normal(n), 10.0 ** -np.arange(n), np.ones(n), np.r_[np.full(n // 2, 3.0), np.ones(n - n // 2)], np.arange(n) - (n - 1) / 2, np.r_[1.0, np.zeros(n - 1)]):
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        a = (q * spectrum) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.leading(a, n)
        size = np.linalg.norm(a)
        assert np.allclose(values, np.sort(spectrum)[::-1], atol=2e-14 * size * n, rtol=0)
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 * n
        assert np.abs(a @ vectors - vectors * values).max() <= 2e-14 * size * n
        few, some = whitening.leading(a, min(3, n))
        assert np.allclose(few, values[:3]) and np.abs(a @ some - some * few).max() <= 2e-14 * size * n


def test_polar_factor():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    values, q = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - (q * np.sign(values)) @ q.T).max() < 1e-13


def test_exact_sums():
    rng = np.random.default_rng(3)
    for most in (5, 2**24, 2**31):
        c = rng.integers(-most, most, (50, 3))
        total = sum(sum(int(a) * int(b) for a, b in zip(c[:, i], c[:, j], strict=True)) for i in range(3) for j in range(3))
        if abs(total) < 2**62:
            assert int(whitening.products(c[:2] if most > 2**30 else c).astype(object).sum()) == (total if most < 2**30 else int((c[:2].astype(object).T @ c[:2].astype(object)).sum()))


SCHEMA = "vec_id long, embedding array<float>, v string, n int, component string"


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(e)) for e in rng.standard_normal(3) * [3, 2, 1]]) for i in range(60)]
    good += [good[0], good[0], (None, good[1][1]), (7, good[9][1])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (None, None)]
    df = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in good + bad], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in whitening.whitened(df).collect()), key=str)
    want = sorted(brute([((-1 if i is None else i), v) for i, v in good]), key=str)
    assert len(got) == len(want) == 3 * len(good) and {g[0] for g in got} == {i for i, _ in good}
    total = {}
    for g in got:
        total[g[1]] = total.get(g[1], 0) + g[4] ** 2
        assert g[2] == len(good) and g[6] < 1e-9
    assert all(abs(t / len(good) - 1) < 1e-9 for t in total.values())
    assert sorted(g[3] for g in got) == sorted(w[3] for w in want)
    check(sorted(g for g in got if g[0] is not None and g[0] > 9), sorted(w for w in want if w[0] > 9))
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id = 0").limit(2)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}
    huge = spark.createDataFrame([(i, [1e300 * (-1) ** i, float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whitened(huge).count() == 18
