"""Chains over frames in chunks against forward-backward and best paths over whole records in plain numpy."""

import numpy as np
import pyarrow as pa
import pytest

from cadenza.operators import chains as H
from cadenza.operators import models as M
from cadenza.operators.models import Chain, Mixture, best_paths

RNG = np.random.default_rng(5)
LENGTHS = {"a": 1, "b": 7, "c": 8, "d": 61, None: 30, "e": 2}
RECORDS = {k: RNG.normal(size=(n, 2)) + np.repeat(RNG.normal(size=(n // 10 + 1, 2)) * 3, 10, axis=0)[:n] for k, n in LENGTHS.items()}


def _own():
    chain = Chain(np.array([0.6, 0.3, 0.1]), np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]]), np.ones((3, 1)))
    return H.FrameChain.of_mixtures(chain, [Mixture(np.array([0.4, 0.6]), RNG.normal(size=(2, 2)) * 2, np.full((2, 2), 1.5)) for _ in range(3)])


def _shared():
    chain = Chain.topology("ERGODIC", 2, 1)
    book = Mixture(np.full(4, 0.25), RNG.normal(size=(4, 2)) * 2, np.full((4, 2), 2.0))
    return H.FrameChain.of_codebook(chain, book, np.array([[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4]]))


def _linear():
    """The last state is hardly ever reached by its densities: they lie beyond what a double can hold."""
    return H.FrameChain.of_mixtures(Chain.topology("LINEAR", 2, 1), [Mixture(np.ones(1), np.full((1, 2), m), np.full((1, 2), 0.01)) for m in (0.0, 30.0)])


def _frames(spark, records=RECORDS):
    rows = [(k, i, v.tolist()) for k, x in records.items() for i, v in enumerate(x)]
    return spark.createDataFrame([rows[i] for i in RNG.permutation(len(rows))], "rec_id string, frame_idx long, x array<double>").repartition(3)


def _density(m, v, x):
    return -0.5 * (((x - m) ** 2 / v).sum() + np.log(2 * np.pi * v).sum())


def _emitted(c, x):
    return np.array([[np.logaddexp.reduce([np.log(c.weights[s, k]) + _density(c.means[k], c.variances[k], v) for k in range(len(c.means)) if c.weights[s, k] > 0]) for s in range(len(c.initial))] for v in x])


def _turn(c, records):
    """One turn in the plain domain, scaled frame by frame."""
    first, moves, occ = np.zeros_like(c.initial), np.zeros_like(c.transitions), np.zeros_like(c.weights)
    sums, squares, ll = np.zeros_like(c.means), np.zeros_like(c.means), 0.0
    for x in records.values():
        logs = _emitted(c, x)
        b = np.exp(logs - logs.max(1, keepdims=True))
        alpha, scale = np.zeros_like(b), np.zeros(len(b))
        for t in range(len(b)):
            alpha[t] = (c.initial if t == 0 else alpha[t - 1] @ c.transitions) * b[t]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        beta = np.ones_like(b)
        for t in range(len(b) - 1, 0, -1):
            beta[t - 1] = c.transitions @ (b[t] * beta[t]) / scale[t]
            moves += c.transitions * np.outer(alpha[t - 1], b[t] * beta[t]) / scale[t]
        gamma = alpha * beta
        first += gamma[0]
        ll += np.log(scale).sum() + logs.max(1).sum()
        for t, v in enumerate(x):
            for s in range(len(c.initial)):
                for k in range(len(c.means)):
                    if c.weights[s, k] > 0:
                        p = gamma[t, s] * c.weights[s, k] * np.exp(_density(c.means[k], c.variances[k], v) - logs[t, s])
                        occ[s, k] += p
                        sums[k] += p * v
                        squares[k] += p * v * v
    n = occ.sum(0)[:, None]
    mean = sums / n
    return H.FrameChain(first / first.sum(), moves / moves.sum(1, keepdims=True), occ / occ.sum(1, keepdims=True), mean, np.maximum(squares / n - mean**2, 1e-3)), ll


@pytest.mark.parametrize("make", [_own, _shared])
@pytest.mark.parametrize("size, fan", [(4, 2), (256, 256)])
def test_training_equals_plain_forward_backward(spark, make, size, fan):
    start = make()
    got, lls = H.train(_frames(spark), start, 3, size=size, fan=fan)
    want, plain = start, []
    for _ in range(3):
        want, ll = _turn(want, RECORDS)
        plain.append(ll)
    assert np.allclose(lls, plain, rtol=1e-9)
    assert all(b >= a - 1e-9 for a, b in zip(lls, lls[1:]))
    for part in ("initial", "transitions", "weights", "means", "variances"):
        assert np.allclose(getattr(got, part), getattr(want, part), rtol=1e-7, atol=1e-10), part
    assert (got.weights[start.weights == 0] == 0).all()
    assert np.allclose(got.mixture(0).weights.sum(), 1)


@pytest.mark.parametrize("make, forced", [(_own, False), (_own, True), (_shared, False), (_linear, True)])
@pytest.mark.parametrize("size, fan", [(3, 2), (256, 256)])
def test_paths_equal_those_of_whole_records(spark, make, forced, size, fan):
    chain = make()
    rows = H.best_states(_frames(spark), chain, forced, size, fan).collect()
    assert len(rows) == sum(LENGTHS.values())
    plain = Chain(chain.initial, chain.transitions, np.ones((len(chain.initial), 1)))
    for k, x in RECORDS.items():
        mine = sorted((r["frame_idx"], r["q"], r["score"]) for r in rows if r["rec_id"] == k)
        q, score = best_paths(plain, _emitted(chain, x)[None], forced)
        if np.isfinite(score[0]):  # a record of one frame can't end in the second state
            assert [r[1] for r in mine] == q[0].tolist()
        assert {r[2] for r in mine} == {mine[0][2]} and (mine[0][2] == score[0] or abs(mine[0][2] - score[0]) <= 1e-9 * abs(score[0]))


def test_ties_are_one_path(spark):
    """All states alike: whatever is taken at the joins, the path must exist in the chain."""
    turn = np.array([[0.0, 1.0], [1.0, 0.0]])
    chain = H.FrameChain(np.array([0.5, 0.5]), turn, np.ones((2, 1)), np.zeros((1, 2)), np.ones((1, 2)))
    rows = H.best_states(_frames(spark), chain, size=3, fan=2).collect()
    for k in RECORDS:
        q = [r["q"] for r in sorted((r for r in rows if r["rec_id"] == k), key=lambda r: r["frame_idx"])]
        assert all(a != b for a, b in zip(q, q[1:]))


SYMBOLS = {k: RNG.integers(0, 4, n) for k, n in LENGTHS.items()}


def _shown():
    """A symbol that one state never shows, and moves that don't exist."""
    return Chain(np.array([0.5, 0.5, 0.0]), np.array([[0.6, 0.4, 0.0], [0.1, 0.7, 0.2], [0.3, 0.0, 0.7]]), np.array([[0.5, 0.2, 0.3, 0.0], [0.1, 0.2, 0.3, 0.4], [0.25, 0.25, 0.0, 0.5]]))


@pytest.mark.parametrize("size, fan", [(4, 2), (256, 256)])
def test_symbols_in_chunks_equal_whole_sequences(spark, size, fan):
    plain, frames = _shown(), _frames(spark, {k: s[:, None].astype(float) for k, s in SYMBOLS.items()})
    table = spark.createDataFrame([(k, s.tolist()) for k, s in SYMBOLS.items()], "rec_id string, symbols array<int>")
    got, lls = H.train(frames, H.SymbolChain.of(plain), 3, size=size, fan=fan)
    want, ll = M.baum_welch(table, plain, 3)
    assert np.allclose(lls, ll, rtol=1e-10) and np.array_equal(got.means[:, 0], np.arange(4))
    for part in ("initial", "transitions", "emissions"):
        assert np.allclose(getattr(got.chain(), part), getattr(want, part), rtol=1e-8, atol=1e-12), part
    for forced in (False, True):
        rows = H.best_states(frames, H.SymbolChain.of(plain), forced, size, fan).collect()
        scores = {r["rec_id"]: r["score"] for r in H.record_scores(frames, H.SymbolChain.of(plain), True, forced, size, fan).collect()}
        for k, s in SYMBOLS.items():
            _, best = M.viterbi(plain, s, forced)
            assert scores[k] == best or abs(scores[k] - best) < 1e-9
            q = [r["q"] for r in sorted((r for r in rows if r["rec_id"] == k), key=lambda r: r["frame_idx"])]
            if np.isfinite(best):  # of paths that tie, any
                with np.errstate(divide="ignore"):
                    own = np.log(plain.initial[q[0]]) + np.log(plain.transitions)[q[:-1], q[1:]].sum() + np.log(plain.emissions)[q, s].sum()
                assert len(q) == len(s) and abs(own - best) < 1e-9 and (not forced or q[-1] == 2)


def test_unknown_symbols_and_missing_ones(spark):
    chain = H.SymbolChain.of(_shown())
    rows = [("bad", 0, [0.0]), ("bad", 1, [9.0]), ("none", 0, None), ("ok", 0, [1.0])]
    frames = spark.createDataFrame(rows, "rec_id string, frame_idx long, x array<double>")
    scores = {r["rec_id"]: r["score"] for r in H.record_scores(frames, chain).collect()}
    assert set(scores) == {"bad", "ok"} and scores["bad"] == -np.inf and abs(scores["ok"] - np.log(0.5 * 0.2 + 0.5 * 0.2)) < 1e-12
    one, lls = H.train(frames, chain, 1)
    assert abs(lls[0] - scores["ok"]) < 1e-12 and np.isfinite(one.weights).all()
    assert H.record_scores(frames.filter("false"), chain).count() == 0


def test_odd_tables(spark):
    chain = _own()
    none = _frames(spark).filter("false")
    assert H.best_states(none, chain).count() == 0
    same, lls = H.train(none, chain, 1)
    assert lls == [0.0] and np.array_equal(same.means, chain.means) and np.array_equal(same.weights, chain.weights)
    gaps = spark.createDataFrame([("r", 900, [0.0, 1.0]), ("r", 5, [1.0, 0.0]), ("r", 6, None)], "rec_id string, frame_idx long, x array<double>")
    found = {r["frame_idx"]: r["q"] for r in H.best_states(gaps, chain, size=4, fan=2).collect()}
    q, _ = best_paths(Chain(chain.initial, chain.transitions, np.ones((3, 1))), _emitted(chain, np.array([[1.0, 0.0], [0.0, 1.0]]))[None])
    assert [found[5], found[900]] == q[0].tolist() and len(found) == 2
    impossible, lls = H.train(_frames(spark, {"x": np.zeros((1, 2))}), H.FrameChain(np.array([0.0, 0.0, 0.0]), chain.transitions, chain.weights, chain.means, chain.variances), 1)
    assert lls == [0.0] and np.array_equal(impossible.transitions, chain.transitions)
    with pytest.raises(ValueError):
        H.chunked(none, 0)
    with pytest.raises(ValueError):
        H.best_states(none, chain, fan=1)


def test_chunks_go_side_by_side():
    """Many short chunks are few slices, each within bounds, and none of their frames is lost."""
    r = np.random.default_rng(4)
    made = [r.normal(0, 1, (int(n), 2)) for n in r.integers(1, 257, 3000)]
    slices = list(H._side_by_side(pa.array([m.ravel().tolist() for m in made])[1:], 2, 12))
    assert len(slices) < 100 and sorted(int(i) for rows, _, _ in slices for i in rows) == list(range(2999))
    for rows, lengths, x in slices:
        assert x.shape[0] * x.shape[1] * 12 <= H._CELLS
        assert all(np.array_equal(v[:n], made[i + 1]) and np.array_equal(v[n:], np.repeat(v[n - 1 : n], len(v) - n, 0)) for i, n, v in zip(rows, lengths, x, strict=True))
