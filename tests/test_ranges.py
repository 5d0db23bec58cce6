"""Binary files read by byte ranges, and lists of files as one stream of samples."""

import struct
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.sources import formats


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_a_frame_file_is_many_tasks(spark, folder):
    x = np.random.default_rng(2).standard_normal((1000, 5)).astype("<f4")
    with open(f"{folder}/a.ft", "wb") as f:
        f.write(formats.encode_frames(x))
    with open(f"{folder}/b.ft", "wb") as f:
        f.write(formats.encode_frames(x[:0]))
    rows = formats.read_frames(spark, folder, range_bytes=20 * 90).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 1 and len(rows) == 1000
    assert np.array_equal(np.array([r.x for r in sorted(rows, key=lambda r: r.frame_idx)], "<f4"), x)


def test_sample_files(spark, folder):
    c, y, x = np.arange(300) % 7, np.arange(300) % 3, np.arange(900, dtype=np.float64).reshape(300, 3)
    with open(f"{folder}/a.samples", "wb") as f:
        f.write(formats.encode_samples(c, y, x))
    rows = sorted(formats.read_samples(spark, folder, range_bytes=500).collect(), key=lambda r: r.idx)
    assert [(r.idx, r.c, r.y, r.x) for r in rows] == [(i, c[i], y[i], x[i].tolist()) for i in range(300)]


@pytest.mark.parametrize("raw", [b"\1\0", struct.pack("<i", 3) + b"12345", struct.pack("<i", -1)])
def test_broken_frame_files_raise(spark, folder, raw):
    with open(f"{folder}/bad.ft", "wb") as f:
        f.write(raw)
    with pytest.raises(Exception, match="width|whole"):
        formats.read_frames(spark, folder).collect()


@pytest.mark.parametrize("n", [0, 1, 40, 41])
def test_audio_chunks(spark, folder, n):
    values = np.round(np.sin(np.arange(n)) * 32767) / 32767
    with open(f"{folder}/a.wav", "wb") as f:
        f.write(formats.encode_wav(values))
    rows = sorted(formats.read_audio(spark, folder, chunk=20).collect(), key=lambda r: r.chunk_idx)
    assert [len(r.samples) for r in rows] == [20] * (n // 20) + [n % 20] * (n % 20 > 0) and [r.chunk_idx for r in rows] == list(range(len(rows)))
    assert np.allclose([v for r in rows for v in r.samples], values, atol=1e-9)


def test_lists_keep_their_order_and_skip_what_is_broken(spark, folder):
    parts = {"a": np.full(5, 0.5), "b": np.full(8, -0.25), "c": np.zeros(0), "d": np.full(3, 0.125)}
    for name, values in parts.items():
        with open(f"{folder}/{name}.wav", "wb") as f:
            f.write(formats.encode_wav(values))
    with open(f"{folder}/no.wav", "wb") as f:
        f.write(b"no audio at all")
    order = ["d", "no", "b", "gone", "a", "c", "b"]
    listed = spark.createDataFrame([(i, f"file://{folder}/{n}.wav") for i, n in enumerate(order)], "pos long, path string")
    rows, skipped = formats.concatenated_audio(listed, buffer=4)
    want = []
    for n in order:
        if n in parts:
            want += parts[n].tolist() + [0.0] * (-len(parts[n]) % 4)
    found = sorted(rows.collect())
    assert [r.idx for r in found] == list(range(len(want))) and np.allclose([r.value for r in found], want, atol=1e-4)
    assert sorted(r.pos for r in skipped.collect()) == [1, 3]
