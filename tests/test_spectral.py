import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import sequence as S
from cadenza.operators import spectral as P

# YIN of 256 samples of a sine at 8 kHz.
TONES = {80: 80.001, 100: 100.006, 120: 120.007, 200: 200.046, 220: 220.054, 300: 300.097, 440: 440.649}


@pytest.mark.parametrize("hz", sorted(TONES))
def test_yin_of_tones(hz):
    frame = (0.3 * np.sin(2 * np.pi * hz * np.arange(256) / 8000)).astype(np.float32)
    assert abs(P.yin(frame, 8000.0) - TONES[hz]) < 0.01


def test_yin_of_silence_and_constants():
    assert P.yin(np.full(256, 0.3, np.float32), 8000.0) == -1 and P.yin(np.zeros(256, np.float32), 8000.0) == -1
    assert P.yin(np.random.default_rng(42).normal(0, 0.1, 256).astype(np.float32), 8000.0) == -1 and P.yin(np.zeros(3, np.float32), 8000.0) == -1


def test_mel_bank_of_the_default():
    w = P.MelBank().weights()
    assert w.shape == (20, 257) and np.allclose(w.sum(1), 1)
    assert list(np.flatnonzero(w[0])[[0, -1]]) == [12, 25] and list(np.flatnonzero(w[-1])) == [256]


def test_dct_is_orthonormal_and_acf_matches_the_definition():
    b = P.dct_basis(20)
    assert np.allclose(b @ b.T, np.eye(20))
    r = np.array([[1.0, 0.5, 0.25, 0.125]])
    a, e = P.levinson(r, 2)
    assert np.allclose(a, [[1, -0.5, 0]]) and np.allclose(e, 0.75)


def test_columns_of_mixed_lengths(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, []), (4, [1.0, 0.0])]
    got = {r.i: r.y for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", P.hartley_transform(F.col("x")).alias("y")).collect()}
    f = np.fft.fft([1.0, 2, 3, 4])
    assert np.allclose(got[1], f.real - f.imag) and got[2] is None and got[3] == [] and np.allclose(got[4], [1, 1])


@pytest.mark.parametrize("n", [1, 255, 256, 257, 384, 1000])
def test_number_of_frames(spark, n):
    table = spark.range(n).selectExpr("'r' as rec_id", "id as idx", "double(id) as value")
    got = {r.frame_idx: r.x for r in S.overlapped(table, 256, 128).collect()}
    assert len(got) == (2 + (n - 256) // 128 if n >= 256 else 1)
    for i, x in got.items():
        want = [float(v) if v < n else 0.0 for v in range(i * 128, i * 128 + 256)]
        assert x == want


def test_segment_ends():
    assert [S.segment_end(d) for d in range(1, 9)] == [60, 122, 185, 247, 310, 372, 435, 497]


def test_delta_of_a_ramp_and_smoothing(spark):
    ramp = spark.range(4).selectExpr("'r' as rec_id", "id as frame_idx", "array(double(id)) as x")
    assert [r.x[0] for r in S.regression_delta(ramp).orderBy("frame_idx").collect()] == [0.5, 1.0, 1.0, 0.5]
    long = spark.range(30).selectExpr("'r' as rec_id", "id as frame_idx", "array(double(id)) as x")
    rows = S.shifted_delta(long).collect()
    assert len(rows) == 30 - 20 and all(set(r.x) == {2.0} for r in rows)
    flags = spark.createDataFrame([("r", i, v) for i, v in enumerate([0, 0, 1, 0, 0, 0])], "rec_id string, frame_idx long, voiced int")
    assert [r.voiced for r in S.smooth_voicing(flags).orderBy("frame_idx").collect()] == [0] * 6


def test_frames_are_transformed_in_slices(spark):
    """Frames of several lengths, empty and null ones come back in their rows; no call gets more than a slice."""
    r = np.random.default_rng(3)
    rows = [(i, None if i % 7 == 0 else r.normal(0, 1, (16, 24, 0)[i % 3]).tolist()) for i in range(1500)]
    top = P.SLICE // 1024

    def run(m):
        assert len(m) <= top
        return np.concatenate([m[:, ::-1], m.sum(1, keepdims=True)], 1)

    df = spark.createDataFrame(rows, "i int, x array<double>").coalesce(1)
    got = {g["i"]: g for g in df.select("i", P._batched(run)("x").alias("y"), P.yin_pitch(F.col("x")).alias("p")).collect()}
    for i, x in rows:
        if x is None:
            assert got[i]["y"] is None and got[i]["p"] is None
        else:
            assert np.allclose(got[i]["y"], x[::-1] + [sum(x)] if x else []) and got[i]["p"] == P.yin(np.array(x), 8000.0)
