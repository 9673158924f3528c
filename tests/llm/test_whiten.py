"""Whitening against a plain eigen-solve of the exact covariance."""

from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import whiten


def vectors(n, d, seed=1):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.linspace(1, 3, d)).astype(np.float32)


def brute(rows, k):
    """(n, S, mean, leading eigenpairs, trace) of the distinct x."""
    fit = sorted({tuple(int(np.floor(256 * np.float64(c))) for c in v) for v in rows})
    x = np.array(fit, dtype=np.float64)
    cov = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) / len(x)
    e, q = np.linalg.eigh(cov)
    return len(fit), [sum(c) for c in zip(*fit, strict=True)], e[::-1][:k], q[:, ::-1][:, :k].T, cov.trace()


@pytest.mark.parametrize(("n", "d", "parts"), [(300, 8, 5), (400, 3, 40), (50, 2, 1)])
def test_equals_a_plain_solve(spark, n, d, parts, monkeypatch):
    monkeypatch.setattr(whiten, "FAN", 3)
    v = vectors(n, d)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, v[0].tolist())] * 20
    got = whiten.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)).collect()
    size, sums, e, q, trace = brute(v, 4)
    k = min(4, d)
    assert len(got) == len(rows) * k and {r.n for r in got} == {size}
    by = {}
    for r in got:
        by[r.vec_id, r.component] = r
    mean = [Fraction(s, size) for s in sums]
    for c in range(k):
        column = np.array([[float(int(np.floor(256 * np.float64(x))) - m) for x, m in zip(y, mean, strict=True)] for y in v]) @ q[c] / np.sqrt(e[c])
        mine = np.array([by[i, c + 1].whitened for i in range(n)])
        assert min(np.abs(mine - column).max(), np.abs(mine + column).max()) < 1e-9
        assert abs(by[0, c + 1].explained - e[c] / trace) < 1e-9
    assert by[1000, 1].whitened == by[0, 1].whitened and by[0, 1].identity_error < 1e-9
    x = [int(np.floor(256 * np.float64(c))) for c in v[7]]
    assert by[7, 1].deviation == sum((size * a - s) ** 2 for a, s in zip(x, sums, strict=True))


def test_eigen_of_hard_matrices():
    for a in (np.zeros((3, 3)), np.diag([1.0, 1, 2, 0]), np.ones((5, 5)), np.array([[2.0]]), np.diag([1e-9, 1e9, 1.0])):
        e, q = whiten.eigen(a)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).max()))
        assert np.allclose(q @ q.T, np.eye(len(a)), atol=1e-12)


def test_merged_states_equal_one_stream():
    v = vectors(100, 4).astype(np.float64)
    one = whiten.Moments.none(4)
    for part in np.array_split(v, 7):
        one = one.merged(whiten.Moments(len(part), [0] * 4, part.mean(axis=0), (part - part.mean(axis=0)).T @ (part - part.mean(axis=0))))
    assert one.n == 100 and np.allclose(one.products, np.cov(v.T, bias=True) * 100)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, [5.0, 7.5]), (9, [-0.001, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'clash' as x", "'clash' as n", "1 as component")
    got = whiten.whitened(table).collect()
    assert sorted((r.vec_id for r in got if r.component == 1), key=str) == [1, 1, 8, 9, None]
    assert {r.n for r in got} == {4} and {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    assert whiten.whitened(table.limit(0)).count() == 0
    assert whiten.whitened(table.where("vec_id = 1")).count() == 0  # no variance
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten.whitened(far).collect() if r.vec_id == 1} == {None}
