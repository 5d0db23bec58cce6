"""Nuisance directions against the matrix of weights between all pairs."""

import numpy as np
import pytest

from cadenza.operators import nuisance as N
from cadenza.operators.clustering import remove_nuisance

RNG = np.random.default_rng(3)


def _frames(spark, sizes, d, clash=False):
    rows, out = [], []
    for c, n in enumerate(sizes):
        shift = RNG.normal(size=d) * 2
        for k in range(n):
            x = RNG.normal(size=d) * np.linspace(3, 0.1, d) + shift
            rows.append((c if c else None, k, x.tolist()))
            out.append((c, k, x))
    df = spark.createDataFrame(rows + [(1, 99, None)], "c int, k int, x array<double>")
    return (df.selectExpr("c", "k", "x", "1 as w", "2 as n", "3 as at", "4 as v") if clash else df).repartition(3), out


def _scatter(rows, weight):
    x = np.array([r[2] for r in rows])
    w = np.array([[float(weight(a, b)) for b in rows] for a in rows])
    return x.T @ (np.diag(w.sum(1)) - w) @ x


def _same(basis, whole, rank):
    values, vectors = np.linalg.eigh(whole)
    lead = vectors[:, np.argsort(-values)[:rank]]
    assert np.allclose(basis.T @ basis, lead @ lead.T, atol=1e-4)


@pytest.mark.parametrize("sizes, d", [((9, 14, 30), 5), ((3, 5), 40)])
@pytest.mark.parametrize("widest", [2048, 1])
def test_channels(spark, sizes, d, widest):
    frames, rows = _frames(spark, sizes, d, clash=True)
    table = N.channel_rows(frames, "c")
    want = _scatter(rows, lambda a, b: a[0] != b[0])
    assert np.allclose(N.scatter(table), want, rtol=1e-9, atol=1e-8)
    basis, values = N.directions(table, 3, widest)
    _same(basis, want, 3)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(want))[::-1][:3], rtol=1e-6)
    left = np.array([r["x"] for r in remove_nuisance(frames.filter("x is not null"), basis).collect()])
    assert np.abs(left @ basis.T).max() < 1e-8


def test_sessions(spark):
    frames, rows = _frames(spark, (6, 6, 6), 4)
    frames = frames.na.fill({"c": 0})
    want = _scatter(rows, lambda a, b: a[0] != b[0] and a[1] == b[1])
    assert np.allclose(N.scatter(N.session_rows(frames, "c", "k")), want, rtol=1e-9, atol=1e-8)
    _same(N.directions(N.session_rows(frames, "c", "k"), 2)[0], want, 2)
    frames, rows = _frames(spark, (6, 4), 3)
    frames = frames.na.fill({"c": 0})
    assert np.allclose(N.scatter(N.session_rows(frames, "c", "k", ragged=True)), _scatter(rows, lambda a, b: a[0] != b[0] and a[1] == b[1]), atol=1e-8)
    with pytest.raises(Exception, match="differ in length"):
        N.scatter(N.session_rows(frames, "c", "k"))
    with pytest.raises(Exception, match="two frames"):
        N.scatter(N.session_rows(frames.union(frames), "c", "k"))


def test_odd_tables(spark):
    frames, _ = _frames(spark, (3,), 2)
    assert np.allclose(N.scatter(N.channel_rows(frames.filter("c is null"), "c")), 0, atol=1e-9)  # one channel: no pair
    none = frames.filter("false")
    assert N.directions(N.channel_rows(none, "c"), 2)[0].size == 0 and N.directions(N.session_rows(none, "c", "k"), 2)[0].size == 0
    with pytest.raises(ValueError):
        N.directions(N.channel_rows(frames, "c"), 0)
