import numpy as np
import pytest

from cadenza.operators import models as M
from cadenza.operators import speakers as P


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1, (60, 3)) for c in (-4, 0, 5)])
    table = spark.createDataFrame([(int(i // 60), int(i), v.tolist()) for i, v in enumerate(x)], "rec_id int, frame_idx long, x array<double>").repartition(4)
    return x, table


def test_em_against_numpy(data):
    x, table = data
    start = M.Mixture(np.full(3, 1 / 3), np.array([[-3.0] * 3, [1.0] * 3, [4.0] * 3]), np.ones((3, 3)))
    got = M.em(table, start, turns=4)
    w, m, v = start.weights, start.means, start.variances
    for _ in range(4):
        log = M.Mixture(w, m, v).score(x)
        p = np.exp(log - log.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        occ = p.sum(0)
        m = p.T @ x / occ[:, None]
        v = np.maximum(p.T @ (x * x) / occ[:, None] - m * m, 1e-3)
        w = occ / occ.sum()
    assert np.allclose(got.means, m) and np.allclose(got.variances, v) and np.allclose(got.weights, w)
    assert all(b >= a - 1e-9 for a, b in zip(got.history, got.history[1:], strict=False))
    kept = M.map_adapt(table, start, relevance=1e12, parameters="m")
    assert np.allclose(kept.means, start.means, atol=1e-6)
    with pytest.raises(ValueError):
        M.map_adapt(table, start, parameters="x")


def test_clusters_and_projections(data):
    x, table = data
    at = M.k_means(table, x[[0, 60, 120]])
    assert np.allclose(np.sort(at[:, 0]), np.sort([x[i : i + 60, 0].mean() for i in (0, 60, 120)]), atol=0.2)
    assert len(M.lbg(table, 3, turns=5)) == 3
    p = M.pca(table)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    assert np.allclose(p.values, values) and np.allclose(p.rows @ p.rows.T, np.eye(3))
    d = M.lda(table, "rec_id")
    y = np.array([r.x[0] for r in d.apply(table, 1).orderBy("frame_idx").collect()])
    means = [y[i : i + 60].mean() for i in (0, 60, 120)]
    assert len(d.rows) == 2 and (means == sorted(means) or means == sorted(means, reverse=True)) and max(y[i : i + 60].std() for i in (0, 60, 120)) < abs(means[0] - means[2]) / 4


def test_viterbi_and_baum_welch_against_enumeration(spark):
    from itertools import product

    rng = np.random.default_rng(1)
    chain = M.Chain(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]]))
    seqs = [rng.integers(0, 3, n).tolist() for n in (1, 4, 7)] + [[]]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "rec_id int, symbols array<int>")

    def p(q, s):
        out = chain.initial[q[0]] * chain.emissions[q[0], s[0]]
        for a, b, o in zip(q, q[1:], s[1:], strict=False):
            out *= chain.transitions[a, b] * chain.emissions[b, o]
        return out

    got = {r.rec_id: r for r in M.decode(table, chain).collect()}
    total = 0.0
    for i, s in enumerate(seqs[:3]):
        paths = list(product(range(2), repeat=len(s)))
        best = max(paths, key=lambda q: p(q, s))
        assert tuple(got[i].q) == best and abs(got[i].score - np.log(p(best, s))) < 1e-9
        total += np.log(sum(p(q, s) for q in paths))
    assert got[3].q == []
    new, lls = M.baum_welch(table, chain, turns=3)
    assert abs(lls[0] - total) < 1e-9 and lls[0] <= lls[1] + 1e-9 <= lls[2] + 2e-9
    assert np.allclose(new.transitions.sum(1), 1) and np.allclose(new.emissions.sum(1), 1)
    linear = M.Chain.topology("LINEAR", 2, 3)
    q, _ = M.viterbi(linear, np.array([0, 1, 2, 0]), forced=True)
    assert list(q) == sorted(q) and q[-1] == 1


VOICE = P.Voice(0.3, 50, 450, 100, 160, 190)


def _fold(segs, same, different):
    """Plain Python: the greedy count."""
    angle = lambda a, b: np.degrees(np.arccos(np.clip(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b), -1, 1)))
    gender = lambda p: 1 if p < 160 else 2 if p > 190 else 0
    found = []
    for s, n, pitch in segs:
        decide = lambda f: -1 if 0 in (gender(f[2]), gender(pitch)) else int(gender(f[2]) == gender(pitch))  # noqa: B023, E731
        like = next((i for i, f in enumerate(found) if angle(f[0], s) <= same and decide(f) == 1), None)
        if like is not None:
            f = found[like]
            found[like] = (np.add(f[0], s), f[1] + n, (f[2] + pitch) / 2)
        elif all(decide(f) == 0 or angle(f[0], s) >= different for f in found):
            found.append((s, n, pitch))
    return len(found)


def test_speaker_counts_against_plain_python(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for rec in range(12):
        segs = [((rng.normal(0, 0.15, 4) + np.eye(4)[rng.integers(0, 4)]).tolist(), 4, float(rng.choice([100, 120, 175, 220]))) for _ in range(rng.integers(1, 12))]
        want[rec] = _fold(segs, 20.0, 40.0)
        rows += [(rec, i, *s) for i, s in enumerate(segs)]
    table = spark.createDataFrame(rows, "rec_id int, seg_id long, s array<double>, n int, pitch double")
    got = {r.rec_id: r.speakers for r in P.count_speakers(P._ordered(table), 20.0, 40.0, VOICE).collect()}
    assert got == want
    same = spark.createDataFrame([(1, i, [1.0, 0.5], 4, 100.0) for i in range(5)], "rec_id int, seg_id long, s array<double>, n int, pitch double")
    assert P.merge_neighbours(P._ordered(same), 15.6, VOICE).selectExpr("size(segs) n").first().n == 1
    owner = spark.createDataFrame([([1.0, 0.5], 100.0)], "s array<double>, pitch double")
    r = P.count_with_owner(P._ordered(same), owner, (15.6, 21.6), (15.6, 21.6), VOICE).first()
    assert r.speakers == 1 and r.percentage == 100.0


def test_full_gaussian_scores_of_whole_vectors(spark):
    from cadenza.plans import registered

    sf = "/root/testdata/sf0.001"
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float)
    d, cov = x - x.mean(0), np.cov(x.T, bias=True)
    want = -0.5 * ((d @ np.linalg.inv(cov) * d).sum(1) + np.linalg.slogdet(cov)[1] + 64 * np.log(2 * np.pi))
    got = [r.score for r in registered().QUERIES["sta2_full_gaussian_scores"](spark, sf).collect()]
    assert np.allclose(sorted(got), np.sort(want), atol=1e-4)


def _plain_merge(segs, same):
    """Segments (s, n, pitch) merged with their neighbours until no round merges any, and the number of rounds."""
    rounds = 0
    while True:
        done = []
        for s, n, pitch in segs:
            if done and np.degrees(np.arccos(np.clip(done[-1][0] @ s / np.linalg.norm(done[-1][0]) / np.linalg.norm(s), -1, 1))) <= same:
                a = done[-1]
                done[-1] = (a[0] + s, a[1] + n, (a[2] + pitch) / 2)
            else:
                done.append((s, n, pitch))
        rounds += 1
        if len(done) == len(segs):
            return done, rounds
        segs = done


def test_neighbours_merge_until_stable(spark):
    # Angles and weights for which each round lets one more segment join: light segments on one side, a heavy tail that draws them in.
    rng = np.random.default_rng(0)
    best, most = None, 0
    for _ in range(3000):
        n = rng.integers(5, 40)
        turn, size = np.radians(rng.uniform(0, 60, n)), 10.0 ** rng.uniform(-2, 2, n)
        segs = [(np.array([np.cos(a), np.sin(a)]) * w, 1.0, 100.0) for a, w in zip(turn, size, strict=True)]
        rounds = _plain_merge(segs, 15.0)[1]
        if rounds > most:
            best, most = segs, rounds
    assert most > 3
    rows = [(1, i, s.tolist(), n, p) for i, (s, n, p) in enumerate(best)] + [(2, 0, [1.0, 0.0], 1.0, 100.0)]
    table = spark.createDataFrame(rows, "rec_id int, seg_id long, s array<double>, n double, pitch double")
    got = {r.rec_id: r.segs for r in P.merge_neighbours(P._ordered(table), 15.0, VOICE).collect()}
    want = _plain_merge(best, 15.0)[0]
    assert len(got[2]) == 1 and np.allclose([g.s for g in got[1]], [w[0] for w in want])


def test_iterative_queries_run_to_their_stop_rules(spark):
    from cadenza.plans import model_queries as Q
    from cadenza.plans.bindings import frames

    sf = "/root/testdata/sf0.001"
    at = np.zeros((4, 64))
    for r in Q.k_means(spark, sf).collect():
        at[r.c, r.k] = r.v
    assert np.abs(M.k_means(frames(spark, sf), at, turns=1) - at).sum() <= 1e-5
