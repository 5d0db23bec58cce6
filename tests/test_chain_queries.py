"""The registered queries of chains and nuisance directions against plain numpy over the whole small table."""

import numpy as np
import pytest

from cadenza.operators.models import Chain, best_paths
from cadenza.plans import chain_queries as Q
from cadenza.plans.catalog import QUERIES
from tests.test_chains import _emitted, _turn

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records(spark):
    out = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect():
        out.setdefault(r["label"], []).append([float(v) for v in r["embedding"]])
    return {k: np.array(v) for k, v in out.items()}


def _start(records):
    n = sum(len(x) for x in records.values())
    return [(len(records[c]) / n, records[c].mean(0), np.maximum(records[c].var(0), 1e-10)) for c in sorted(records)]


@pytest.mark.parametrize("name, shared", [("sta28_train_mixtures", False), ("sta28_train_shared_codebook", True)])
def test_training(spark, records, name, shared):
    rows = {(r["part"], r["i"], r["j"]): r["v"] for r in QUERIES[name](spark, SF).collect()}
    classes = _start(records)
    w, m, s = (np.array([c[i] for c in classes]) for i in range(3))
    if shared:
        weights = np.array([[3.0 if c % 3 == q else 1.0 for c in range(len(w))] for q in range(3)])
        states = 3
    else:
        states = (len(w) + 1) // 2
        weights = np.array([[w[c] if c // 2 == q else 0.0 for c in range(len(w))] for q in range(states)])
    chain = Q.H.FrameChain(np.full(states, 1 / states), np.full((states, states), 1 / states), weights / weights.sum(1, keepdims=True), m, s)
    for turn in range(3):
        chain, ll = _turn(chain, records)
        assert abs(rows["log likelihood", turn, 0] - ll) <= 1e-8 * abs(ll)
    for part in ("transitions", "weights", "means", "variances"):
        want = getattr(chain, part)
        got = np.array([[rows[part, i, j] for j in range(want.shape[1])] for i in range(want.shape[0])])
        assert np.allclose(got, want, rtol=1e-6, atol=1e-9), part


def test_best_states(spark, records):
    rows = QUERIES["sta28_sta27_best_states"](spark, SF).collect()
    classes = _start(records)
    w, m, s = (np.array([c[i] for c in classes]) for i in range(3))
    states = (len(w) + 1) // 2
    weights = np.array([[w[c] if c // 2 == q else 0.0 for c in range(len(w))] for q in range(states)])
    chain = Q.H.FrameChain(np.full(states, 1 / states), np.full((states, states), 1 / states), weights / weights.sum(1, keepdims=True), m, s)
    assert len(rows) == sum(len(x) for x in records.values())
    for k, x in records.items():
        q, score = best_paths(Chain(chain.initial, chain.transitions, np.ones((states, 1))), _emitted(chain, x)[None])
        mine = sorted((r["frame_idx"], r["q"], r["score"]) for r in rows if r["rec_id"] == k)
        assert [r[1] for r in mine] == q[0].tolist() and abs(mine[0][2] - score[0]) < 1e-3


@pytest.mark.parametrize("name, session", [("sta21_channel_compensation", False), ("sta21_session_compensation", True)])
def test_compensation(spark, records, name, session):
    found = {(r["rec_id"], r["frame_idx"], r["k"]): r["v"] for r in QUERIES[name](spark, SF).collect()}
    rows = [(c, i, v) for c, x in records.items() for i, v in enumerate(x)]
    x = np.array([r[2] for r in rows])
    c, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    w = (c[:, None] != c[None]) & ((p[:, None] == p[None]) if session else True)
    scatter = x.T @ (np.diag(w.sum(1)) - w.astype(float)) @ x
    values, vectors = np.linalg.eigh(scatter)
    lead = vectors[:, np.argsort(-values)[:2]]
    want = x - x @ lead @ lead.T
    got = np.array([[found[r[0], r[1], k] for k in range(x.shape[1])] for r in rows])
    assert np.abs(got - want).max() < 1e-4


def test_every_pair_meets_once_in_blocks(spark):
    from cadenza.operators.speakers import every_pair

    a = spark.createDataFrame([(i % 3 if i < 50 else 7, i) for i in range(90)], "k long, x long")
    b = spark.createDataFrame([(i % 2, i) for i in range(40)] + [(None, 99)], "k long, y long")
    for rows in (1, 7, 2048):
        got = sorted((r["x"], r["y"]) for r in every_pair(a, b, ["k"], rows).collect())
        assert got == sorted((r["x"], r["y"]) for r in a.join(b, "k").collect())
        assert every_pair(a, b.select("y"), [], rows).count() == 90 * 41
    assert every_pair(a.filter("false"), b, ["k"]).count() == 0 and every_pair(a, b.select("y").filter("false"), []).count() == 0
