"""Eigenvectors against numpy, the exact sums against Python integers, and odd vectors."""

import math

import numpy as np
import pytest

from tidalgrid.llm.queries.op12_whitening import op12_whitening
from tidalgrid.llm.spectral import eigenvectors, polar_factor
from tidalgrid.llm.whitening import whiten

RNG = np.random.default_rng(5)
TURN = np.linalg.qr(RNG.normal(size=(20, 20)))[0]
MATRICES = {
    "one": np.array([[2.0]]), "none": np.zeros((0, 0)), "zero": np.zeros((4, 4)), "identity": np.eye(5), "swap": np.array([[0.0, 1], [1, 0]]), "ones": np.ones((6, 6)),
    "diagonal": np.diag([3.0, 3, 1, 1, 1, 5]), "two values": TURN @ np.diag([5.0] * 10 + [1.0] * 10) @ TURN.T,
    "graded": TURN @ np.diag(10.0 ** -np.arange(20)) @ TURN.T, "negative": -np.cov(RNG.normal(size=(12, 300))),
    "few rows": np.cov(RNG.normal(size=(30, 64)).T), "wide": np.cov((RNG.normal(size=(3000, 64)) * np.linspace(1, 300, 64)).T),
}


@pytest.mark.parametrize("name", MATRICES)
def test_eigenvectors(name):
    a = MATRICES[name]
    e, v = eigenvectors(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-14 * size)
    assert np.abs(v.T @ v - np.eye(len(a))).max(initial=0) < 1e-14 * max(1, len(a))
    assert np.abs(a @ v - v * e).max(initial=0) < 1e-14 * size * max(1, len(a)) ** 0.5
    assert (np.diff(e) <= 0).all()


def test_polar_factor():
    a = RNG.normal(size=(12, 12))
    u = polar_factor(a)
    h = u.T @ a
    assert np.allclose(u.T @ u, np.eye(12), atol=1e-13) and np.allclose(h, h.T, atol=1e-12) and np.linalg.eigvalsh(h).min() > 0


def brute(rows, most=8):
    """Everything of the contract from Python integers and numpy's eigenvectors."""
    rows = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(rows), len(rows[0][1])
    sums = [sum(x[k] for _, x in rows) for k in range(d)]
    far = np.array([[n * x[k] - sums[k] for k in range(d)] for _, x in rows], object)
    cov = np.array([[int(far[:, i] @ far[:, j]) / n**3 for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, d)
    w = (far / n).astype(float) @ v[:, :k] / np.sqrt(e[:k])
    return [(i, c + 1, n, int((far[r] * far[r]).sum()), w[r, c], e[c] / np.trace(cov)) for r, (i, _) in enumerate(rows) for c in range(k)]


def same(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rows if r[1] == c]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8  # either sign, one for all rows
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] < 1e-9 for r in got)


def test_query_equals_brute_force(spark, small_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    same(op12_whitening(spark, small_dir).collect(), brute(rows))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, RNG.normal(size=3).astype(np.float32).tolist()) for i in range(40)]
    rows = [*good, good[0], good[0], (None, good[1][1]), (90, None), (91, [1.0, None, 2.0]), (92, [nan, 0.0, 1.0]), (93, [inf, 0.0, 1.0]), (94, [0.0, -inf, 1.0]), (95, []), (96, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, vector int, key string").repartition(5)
    same(whiten(df).collect(), brute([r for r in rows if r[0] is None or r[0] < 90]))


def test_without_variance_or_rows(spark):
    shape = "vec_id long, embedding array<float>"
    got = whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], shape)).collect()
    assert sorted(map(tuple, got)) == [(i, c, 3, 0, None, None, None) for i in range(3) for c in (1, 2)]
    got = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], shape)).orderBy("vec_id", "component").collect()
    assert [r.explained for r in got] == [1.0, 0.0] * 2 and [r.whitened for r in got][1::2] == [None, None]
    assert abs(got[0].whitened) == abs(got[2].whitened) == 1.0 and got[0].deviation == 1024**2
    assert whiten(spark.createDataFrame([], shape)).collect() == [] == whiten(spark.createDataFrame([(1, None), (2, [])], shape)).collect()


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float((-1) ** i * 2.0**20)]) for i in range(3)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted([r.deviation for r in got], key=str) == [1 << 62, 1 << 62, None] and all(r.identity_error < 1e-9 for r in got)
