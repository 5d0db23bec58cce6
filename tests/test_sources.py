import os

import numpy as np
import pytest

from cadenza import streaming
from cadenza.operators import sequence as S
from cadenza.sources import formats as X


def put(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)


def test_frame_files(spark, tmp_path):
    rows = np.array([[1.5, -2.25, 0.1], [3.0, 4.0, 1e-3]])
    put(tmp_path / "f", "a.frame", X.encode_frames(rows))
    put(tmp_path / "f", "b.frame", X.encode_frames(rows[:1]))
    got = sorted((os.path.basename(r.rec_id), r.frame_idx, r.x) for r in X.read_frames(spark, str(tmp_path / "f")).collect())
    assert [g[:2] for g in got] == [("a.frame", 0), ("a.frame", 1), ("b.frame", 0)] and got[0][2] == rows[0].astype(np.float32).astype(float).tolist()
    put(tmp_path / "d", "a", X.encode_frames(rows, double=True))
    assert [r.x for r in X.read_frames(spark, str(tmp_path / "d"), double=True).orderBy("frame_idx").collect()] == rows.tolist()
    put(tmp_path / "u", "a", X.encode_frames(rows, header=False))
    assert X.read_frames(spark, str(tmp_path / "u"), dim=3).count() == 2
    with pytest.raises(X.FormatError):
        X.decode_frames(X.encode_frames(rows)[:-1])
    put(tmp_path / "l", "a", b"".join(n.encode().ljust(12, b"\0") + r.astype("<f4").tobytes() for n, r in zip(("one", "two"), rows, strict=True)))
    assert [r.label for r in X.read_labelled_frames(spark, str(tmp_path / "l"), 3).orderBy("frame_idx").collect()] == ["one", "two"]


def test_samples_texts_and_labels(spark, tmp_path):
    x = np.array([[1.0, 2.0], [3.0, 4.0]])
    put(tmp_path / "s", "a", X.encode_samples(np.array([1, 2]), np.array([0, 2]), x))
    assert [(r.c, r.y, r.x) for r in X.read_samples(spark, str(tmp_path / "s")).orderBy("idx").collect()] == [(1, 0, [1.0, 2.0]), (2, 2, [3.0, 4.0])]
    put(tmp_path / "t", "a.txt", b"1 0 0.5 -1\n\n 2 1 3 4\n")
    assert sorted((r.c, r.y, r.x) for r in X.read_text_samples(spark, str(tmp_path / "t")).collect()) == [(1, 0, [0.5, -1.0]), (2, 1, [3.0, 4.0])]
    put(tmp_path / "m", "a.txt", b"1 2\n3 4\n")
    assert sorted(r.x for r in X.read_text_frames(spark, str(tmp_path / "m"), 2).collect()) == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(Exception, match="3 wide"):
        X.read_text_frames(spark, str(tmp_path / "m"), 3).collect()
    frames = spark.createDataFrame([("r", 0, [1.2345, -0.0005]), ("r", 1, [2.0, 3.0])], "rec_id string, frame_idx long, x array<double>")
    X.write_text_frames(frames, str(tmp_path / "o"))
    assert sorted(r.x for r in X.read_text_frames(spark, str(tmp_path / "o"), 2).collect()) == [[1.235, 0.0], [2.0, 3.0]]
    put(tmp_path / "c", "a", b"f1 the words\n\nf2\n")
    assert sorted((r.path, r.words) for r in X.read_transcriptions(spark, str(tmp_path / "c")).collect()) == [("f1", ["the", "words"]), ("f2", [])]
    put(tmp_path / "p", "a", b"x y\nlonely\n")
    assert [tuple(r) for r in X.read_pairs(spark, str(tmp_path / "p")).collect()] == [("x", "y")]
    assert [tuple(r) for r in X.read_pairs(spark, str(tmp_path / "p"), "out").collect()] == [("lonely", "out/lonely")]
    put(tmp_path / "b", "a", b"NSS")
    assert [(r.frame_idx, r.label) for r in X.read_byte_labels(spark, str(tmp_path / "b")).orderBy("frame_idx").collect()] == [(0, "N"), (1, "S"), (2, "S")]


def test_audio(spark, tmp_path):
    values = np.sin(np.arange(1000) / 7) * 0.9
    put(tmp_path / "w", "a.wav", X.encode_wav(values))
    audio = X.read_audio(spark, str(tmp_path / "w"), chunk=300)
    back = X.sample_rows(audio, 300).orderBy("idx").collect()
    assert len(back) == 1000 and max(abs(r.value - v) for r, v in zip(back, values, strict=True)) < 1e-4
    assert X.wav_header(10)[:4] == b"RIFF" and len(X.wav_header(10)) == 44
    for law in ("alaw", "ulaw"):
        table = np.array(X.g711_table(law))
        assert len(table) == 256 and abs(table).max() <= 1 and np.allclose(np.sort(table), np.sort(-table))
    assert X.decode_pcm(bytes([0, 255]), bits=8, signed=False).tolist() == [-1.0, 1.0] and X.decode_pcm(b"\x00\x80\x01").tolist() == [-1.0]
    w, m, v = np.array([0.4, 0.6]), np.ones((2, 3)), np.full((2, 3), 2.0)
    assert all(np.array_equal(a, b) for a, b in zip(X.mixture_of(X.mixture_bytes(w, m, v)), (w, m, v), strict=True))
    n, mean, var, sigma = X.mvn_of(X.mvn_bytes(7, m[0], v[0]))
    assert n == 7 and np.allclose(sigma**2, var) and np.allclose(mean, 1)


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props")
    for i in range(3):
        events.filter(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.replay(spark, str(tmp_path / "in"))
    got: list = []
    q = streaming.teed(stream, lambda b, i: got.append(b.count()), checkpoint=str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sum(got) == events.count()
    q = streaming.running_statistics(stream).writeStream.outputMode("complete").format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    want = {r.user_id: r.n for r in streaming.running_statistics(events).collect()}
    assert {r.user_id: r.n for r in spark.table("stats").collect()} == want
    one = str(tmp_path / "one")
    events.coalesce(1).write.parquet(one)
    q = streaming.framed(streaming.replay(spark, one), 4, 2).writeStream.outputMode("append").format("memory").queryName("framed").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("framed").collect()
    samples = events.selectExpr("user_id as rec_id", "row_number() over (partition by user_id order by ts, event_id) - 1 as idx", "value")
    full = {(r.rec_id, r.frame_idx): r.x for r in S.overlapped(samples, 4, 2).collect()}
    assert rows and all(full[(r.user_id, r.frame_idx)] == r.x for r in rows) and sum(want[u] // 2 - 1 for u in want if want[u] >= 4) == len(rows)
