"""Whitening against numpy's own eigenvectors and exact sums."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tillwise.llm import spectrum as s
from tillwise.llm.queries import op13_whitening

DATA = "/root/testdata/sf0.01"


def covariance(rank, d=40, seed=1):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.zeros(d)
    e[:rank] = 10.0 ** rng.uniform(-4, 4, rank)
    return (q * e) @ q.T


@pytest.mark.parametrize("shift", [-1.0, 0.0, 0.3, 2.0, 1e3])
@pytest.mark.parametrize("d", [1, 2, 3, 17, 40])
def test_inertia(d, shift):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    a = a + a.T
    assert s.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    # Zero pivots everywhere.
    b = np.fliplr(np.eye(d))
    assert s.above(b, 0.5) == (np.linalg.eigvalsh(b) > 0.5).sum()


@pytest.mark.parametrize("v", [
    covariance(40), covariance(40, seed=7), covariance(12), np.diag([5.0, 5, 5, 1, 1, 0.5]), np.eye(33),
    np.zeros((4, 4)), np.diag([3.0, 3 - 1e-9, 3 - 2e-9, 1]), np.array([[2.0]]), np.full((6, 6), 7.0)])
def test_leading_components(v):
    e, w = s.leading(v)
    real = np.linalg.eigvalsh(v)[::-1]
    want = real[real > 1e-11 * max(np.trace(v), 1e-300)][:32]
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-9, atol=1e-13 * np.abs(v).max())
    assert np.allclose(w.T @ w, np.eye(len(e)), atol=1e-12)
    assert np.abs(v @ w - w * e).max(initial=0) <= 1e-12 * max(np.abs(v).sum(), 1e-300)
    if len(e):
        assert np.abs((w / np.sqrt(e)).T @ v @ (w / np.sqrt(e)) - np.eye(len(e))).max() < 1e-4


def test_convergence_is_cubic():
    v = covariance(40, seed=3)
    slices = s.Slices(v)
    low, high, held = slices.isolate(3)
    assert held == 1
    value, _, residuals = s.quotient_iteration(v, low, high, np.zeros((40, 0)), slices.norm, 1)
    assert low < value < high and len(residuals) <= 5


def brute(vectors, most=32):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    y = np.array(x) - np.array(sums) / n
    return x, n, sums, y, y.T @ y / n


def test_query_on_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    got = op13_whitening(spark, DATA).toPandas()
    x, n, sums, y, v = brute(rows.embedding)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:32], w[:, ::-1][:, :32]
    assert len(got) == 32 * len(rows) and set(got.n) == {n} and (got.identity_error < 1e-4).all()
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    want = y @ w / np.sqrt(e)
    signs = np.sign((table * want).sum(axis=0))
    assert np.allclose(table, want * signs, atol=1e-6)
    dev = got.drop_duplicates("vec_id").set_index("vec_id").deviation
    assert dev.loc[rows.vec_id].tolist() == [sum((n * a - b) ** 2 for a, b in zip(r, sums)) for r in x]
    share = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(share, e / np.trace(v), rtol=1e-6)


def test_odd_rows(spark):
    good = [(i, [float(i % 3), 0.5 * i, -1.0], "c") for i in range(20)]
    odd = [(90, None, ""), (91, [1.0, None, 2.0], ""), (92, [float("nan"), 0.0, 0.0], ""), (93, [float("inf"), 0.0, 0.0], ""),
           (94, [1.0, 2.0], ""), (95, [], ""), (None, [2.0, 1.0, 0.0], ""), (3, [0.0, 1.5, -1.0], "")]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>, COMPONENT string")
    got = s.whiten(frame(good + odd)).collect()
    assert len(got) == 22 * 3 and {r.component for r in got} == {1, 2, 3}
    assert {r.n for r in got} == {22} and all(r.identity_error < 1e-4 for r in got)
    assert {r.vec_id for r in got} == {*range(20), None}
    for rows in ([], odd[:6], [good[4]] * 5, good[:1]):
        assert s.whiten(frame(rows)).collect() == []
    wide = s.whiten(frame([(1, [1e300, 0.0], ""), (2, [0.0, 1.0], "")])).collect()
    assert [r.component for r in wide] == [1, 1] and wide[0].deviation is None
    assert s.whiten(frame(good)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_are_exact_beyond_a_long():
    x = np.array([[10**9, 5], [3, 4]])
    sums = [10**9 + 3, 9]
    want = [sum((2 * a - b) ** 2 for a, b in zip(r, sums)) for r in x.tolist()]
    assert s.deviations(x, 2, sums) == want
    n = 10**8
    assert s.deviations(x, n, [n * 10**9, 5]) == [v if v < 1 << 63 else None for v in
                                                   (sum((n * a - b) ** 2 for a, b in zip(r, [n * 10**9, 5])) for r in x.tolist())]
