"""Operators of the chain from samples to counts, against plain Python and numpy."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import scalars as C
from cadenza.operators import clustering as G
from cadenza.operators import models as M
from cadenza.operators import speakers as P
from cadenza.operators import spectral
from cadenza.sources import formats, sinks


def test_quantile_of_the_normal_distribution(spark):
    ps = [1e-9, 1e-4, 0.01, 0.0464, 0.0466, 0.2, 0.5, 0.7, 0.9534, 0.9536, 0.999, 1 - 1e-7]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", C.normal_quantile(F.col("p")).alias("z")).collect()
    for r in rows:
        assert abs(r.z - statistics.NormalDist().inv_cdf(r.p)) < 2e-4


def test_selection_strings(spark):
    t = spark.createDataFrame([("0,3-8,1",), (" 2 ",), ("5-3",)], "s string").select(C.selection_indices(F.col("s")).alias("i")).collect()
    assert [r.i for r in t] == [[0, 3, 4, 5, 6, 7, 8, 1], [2], []]
    with pytest.raises(Exception, match="not an index or range"):
        spark.createDataFrame([("1,x",)], "s string").select(C.selection_indices(F.col("s"))).collect()


def test_windows_and_filters():
    assert spectral.window_weights("triangular", 8).tolist() == [0.25, 0.5, 0.75, 1.0, 0.75, 0.5, 0.25, 0.0]
    assert spectral.window_weights("rectangular", 3).tolist() == [1, 1, 1]
    w = spectral.filter_weights("f,t,100,300:f,r,0,99999:m,t,100,500", 10, 50.0)
    assert np.allclose(w.sum(1), 1) and np.allclose(w[1], 0.1)
    assert np.allclose(w[0][2:7] * 3, [1 / 3, 2 / 3, 1, 2 / 3, 1 / 3]) and w[0][:2].sum() == 0
    for bad in ("f,t,100", "x,t,1,2", "f,q,1,2"):
        with pytest.raises(ValueError, match="not a filter"):
            spectral.filter_weights(bad, 10, 50.0)
    assert spectral.resolution(8000.0, 64) == 62.5


def test_joined_chains_and_impossible_sequences(spark):
    a, b = M.Chain.topology("LINEAR", 2, 2), M.Chain.topology("LINEAR", 3, 3)
    whole = M.joined_chains([a, b])
    assert whole.transitions[1].tolist() == [0, 0.5, 0.5, 0, 0] and whole.initial.tolist() == [1, 0, 0, 0, 0] and whole.emissions.shape == (5, 3)
    never = M.Chain(np.array([1.0, 0.0]), np.array([[0.5, 0.5], [0.0, 1.0]]), np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]))
    good = [[0, 0, 1], [0, 1, 1], [0, 0, 0, 0, 1]]
    table = lambda rows: spark.createDataFrame([(r,) for r in rows], "symbols array<int>")
    want, ll = M.baum_welch(table(good), never)
    got, ll2 = M.baum_welch(table([*good, [0, 2, 1], [1]]), never)
    assert np.allclose(got.transitions, want.transitions) and not np.allclose(got.transitions, never.transitions) and abs(ll[0] - ll2[0]) < 1e-9


def test_missing_codebook(spark):
    books = spark.createDataFrame([(1, 0.5)], "cb long, level double")
    assert M.shared_codebooks(spark.createDataFrame([(7, 1)], "s long, cb long"), books, "cb").count() == 1
    with pytest.raises(Exception, match="missing codebook 2"):
        M.shared_codebooks(spark.createDataFrame([(7, 2)], "s long, cb long"), books, "cb").collect()


def test_two_pass_covariance(spark):
    x = np.random.default_rng(2).standard_normal((300, 5)) @ np.random.default_rng(3).standard_normal((5, 5)) + 1e6
    mean, cov = M.two_pass_gaussian(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>"))
    assert np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True), rtol=1e-6)


def test_log_densities_of_any_id_type(spark):
    g = spark.createDataFrame([("a", 0.25, [0.0, 1.0], [1.0, 2.0]), ("b", 0.75, [1.0, 0.0], [0.5, 1.0])], "id string, weight double, m array<double>, s array<double>")
    f = spark.createDataFrame([(1, [0.5, 0.5]), (2, [3.0, -1.0])], "frame_idx int, x array<double>")
    for r in M.mixture_posteriors(M.log_densities(f, g)).collect():
        logs = [-0.5 * sum(math.log(2 * math.pi * s) + (x - m) ** 2 / s for x, m, s in zip(r.x, m, s, strict=True)) for m, s in (([0.0, 1.0], [1.0, 2.0]), ([1.0, 0.0], [0.5, 1.0]))]
        assert np.allclose([s.score for s in r.scores], logs) and [s.id for s in r.scores] == ["a", "b"]
        whole = math.log(0.25 * math.exp(logs[0]) + 0.75 * math.exp(logs[1]))
        assert abs(r.score - whole) < 1e-9 and abs(sum(p.p for p in r.posteriors) - 1) < 1e-9


def test_timed_segments_and_counts(spark):
    rng = np.random.default_rng(8)
    voice = P.Voice(0.2, 100.0, 300.0, 80.0, 160.0, 190.0)
    n, seconds = 40, 0.16
    pitch = np.where(rng.random(n) < 0.2, -1.0, rng.uniform(90, 310, n))
    x = rng.standard_normal((n, 3))
    f = spark.createDataFrame([("r", i, v.tolist()) for i, v in enumerate(x)], "rec_id string, frame_idx long, x array<double>")
    p = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(pitch)], "rec_id string, frame_idx long, pitch double")
    time = 0.032 + 0.016 * np.arange(n)
    for clamp in (True, False):
        want = {}
        for s in range(int((time[-1] + 1e-9) // seconds)):
            own = [i for i in range(n) if max(0, math.ceil(time[i] / seconds - 1e-9) - 1) == s]
            heard = [pitch[i] for i in own[:-1] if pitch[i] != -1 and (not clamp or 100 <= pitch[i] <= 300)]
            if heard and len(heard) / len(own) >= 0.2 and 100 <= np.mean(heard) <= 300 and np.std(heard) <= 80:
                want[s] = (np.mean(heard), x[own[:-1]].sum(0))
        got = {r.seg_id: r for r in P.timed_segments(f, p, seconds, voice, clamp).collect()}
        assert set(got) == set(want)
        for s, (mu, sums) in want.items():
            assert abs(got[s].pitch - mu) < 1e-9 and np.allclose(got[s].s, sums)
    counted = P.count_in_recordings(f, p.unionByName(spark.createDataFrame([("quiet", 0, -1.0)], p.schema)), seconds, voice, 15.6, 21.6).collect()
    assert {r.rec_id for r in counted} == {"r", "quiet"} and [r.speakers for r in counted if r.rec_id == "quiet"] == [0]
    assert P.owner_model(f, p, seconds, voice, 1e6).count() == 0


def test_written_files(spark, tmp_path):
    """Records longer than an Arrow batch, several to a task; wav headers count their samples."""
    x = np.random.default_rng(4).standard_normal((12_000, 4))
    rows = spark.createDataFrame([(i % 3, i // 3, v.tolist()) for i, v in enumerate(x)], "rec_id long, frame_idx long, x array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        made = sinks.write_frame_files(rows, f"file://{tmp_path}/frames", double=True).collect()
        sinks.write_wav_files(rows.select("rec_id", F.col("frame_idx").alias("idx"), (F.col("x")[0] / 8).alias("value")), f"file://{tmp_path}/wav").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.rows for r in made) == [4000] * 3
    for rec in range(3):
        assert np.array_equal(formats.decode_frames((tmp_path / "frames" / f"{rec}.ft").read_bytes(), True), x[rec::3])
        raw = (tmp_path / "wav" / f"{rec}.wav").read_bytes()
        assert raw[:44] == formats.wav_header(4000) and len(raw) == 44 + 8000
        assert np.allclose(formats.decode_pcm(raw, header=44), np.clip(x[rec::3, 0] / 8, -1, 1), atol=2e-5)
    with pytest.raises(ValueError, match="unknown audio format"):
        sinks.audio_format("mp3")


def test_energy_thresholds(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.normal(1.0, 0.3, 400), rng.normal(6.0, 1.0, 200)])
    t = spark.createDataFrame([([float(v)],) for v in values], "x array<double>")
    assert abs(M.energy_threshold(t, "mean") - values.mean()) < 1e-9
    for strategy in ("cluster", "em1", "em5"):
        assert 1.8 < M.energy_threshold(t, strategy) < 3.8
    assert M.energy_threshold(t.limit(1), "em5") == 0.0
    with pytest.raises(ValueError, match="strategy"):
        M.energy_threshold(t, "other")


def test_pitches_and_paths_of_one_length_go_together():
    """Rows alone give what they give together."""
    rng = np.random.default_rng(7)
    frames = np.stack([np.sin(2 * np.pi * f * np.arange(256) / 8000) + 0.05 * rng.standard_normal(256) for f in (110, 220, 333, 440)] + [np.zeros(256), rng.standard_normal(256)]).astype(np.float32)
    together = spectral.yin_rows(frames, 8000.0)
    assert np.allclose(together, [spectral.yin(f, 8000.0) for f in frames]) and np.allclose(together[:4], [110, 220, 333, 440], rtol=0.02) and together[4] == -1
    chain = M.Chain.topology("ERGODIC", 3, 4)
    chain = M.Chain(chain.initial, np.array([[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.1, 0.1, 0.8]]), rng.dirichlet(np.ones(4), 3))
    symbols = rng.integers(0, 4, (4, 6))
    for forced in (False, True):
        q, score = M.viterbi_rows(chain, symbols, forced)
        for row, s in enumerate(symbols):
            best = max((sum(np.log(chain.transitions[a, b]) for a, b in zip(p, p[1:], strict=False)) + np.log(chain.initial[p[0]]) + sum(np.log(chain.emissions[a, o]) for a, o in zip(p, s, strict=True)) for p in paths(6) if not forced or p[-1] == 2), default=0)
            assert abs(score[row] - best) < 1e-9 and (not forced or q[row, -1] == 2)


def test_emissions_of_mixtures_and_shared_codebooks(spark):
    rng = np.random.default_rng(9)
    book = M.Mixture(np.array([0.3, 0.7]), rng.standard_normal((2, 3)), 0.5 + rng.random((2, 3)))
    weights = np.array([[0.3, 0.7], [1.0, 0.0], [0.5, 0.5]])
    x = rng.standard_normal((5, 3))
    own = [M.Mixture(w, book.means, book.variances) for w in (np.array([0.3, 0.7]), np.array([1 - 1e-300, 1e-300]), np.array([0.5, 0.5]))]
    assert np.allclose(M.shared_emissions(x, book, weights), M.mixture_emissions(x, own))
    chain = M.Chain.topology("LINEAR", 3, 1)
    emitted = M.mixture_emissions(x, own)
    table = spark.createDataFrame([("r", x.tolist()), ("none", [])], "rec_id string, frames array<array<double>>")
    got = {r.rec_id: r for r in M.decode_frames(table, chain, lambda v: M.mixture_emissions(v, own), forced=True).collect()}
    with np.errstate(divide="ignore"):
        a, p = np.log(chain.transitions), np.log(chain.initial)
    best = max(p[q[0]] + sum(a[i, j] for i, j in zip(q, q[1:], strict=False)) + sum(emitted[t, s] for t, s in enumerate(q)) for q in paths(5) if q[-1] == 2)
    assert abs(got["r"].score - best) < 1e-9 and got["r"].q[-1] == 2 and got["none"].q == []


def test_block_nuisance(spark):
    rng = np.random.default_rng(10)
    x, y = rng.standard_normal((200, 6)), rng.integers(0, 3, 200)
    f = spark.createDataFrame([(int(c), i, v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "rec_id int, frame_idx long, x array<double>")
    bases = G.block_nuisance_bases(f, "rec_id", 1, 2)
    within = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in range(3)) / 200
    for b, basis in enumerate(bases):
        part = within[3 * b : 3 * b + 3, 3 * b : 3 * b + 3]
        assert abs(abs(basis[0] @ np.linalg.eigh(part)[1][:, -1]) - 1) < 1e-9
    for r in G.remove_block_nuisance(f, bases).collect():
        want = np.concatenate([x[r.frame_idx, :3] - bases[0][0] * (x[r.frame_idx, :3] @ bases[0][0]), x[r.frame_idx, 3:] - bases[1][0] * (x[r.frame_idx, 3:] @ bases[1][0])])
        assert np.allclose(r.x, want)
    with pytest.raises(ValueError, match="multiple"):
        G.block_nuisance_bases(f, "rec_id", 1, 4)


def test_model_files():
    rng = np.random.default_rng(11)
    mean, rows, values = rng.standard_normal(4), rng.standard_normal((2, 4)), rng.random(2)
    raw = formats.projection_bytes(mean, rows, values)
    assert all(np.array_equal(a, b) for a, b in zip(formats.projection_of(raw), (mean, rows, values), strict=True))
    chain = M.Chain(np.array([0.5, 0.5]), np.array([[0.25, 0.75], [0.0, 1.0]]), rng.dirichlet(np.ones(3), 2))
    raw2 = formats.chain_bytes(chain.initial, chain.transitions, chain.emissions)
    assert all(np.array_equal(a, b) for a, b in zip(formats.chain_of(raw2), (chain.initial, chain.transitions, chain.emissions), strict=True))
    for read, whole in ((formats.projection_of, raw), (formats.chain_of, raw2)):
        with pytest.raises(formats.FormatError):
            read(whole + b"x")


def paths(n, states=3):
    import itertools

    return itertools.product(range(states), repeat=n)
