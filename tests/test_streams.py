"""Stateful operators on streams: restarts, late rows, sources that end, batches that run twice."""

import math
import random
import tempfile

import numpy as np
import pytest

from cadenza.functions.shared import fresh_folder, only_row
from cadenza.streaming import stateful

SCHEMA = "rec_id long, ts timestamp, seq long, x array<double>"


def put(spark, folder, rows):
    """Rows (rec_id, second, seq, x) as one more file."""
    table = spark.createDataFrame(rows, "rec_id long, at long, seq long, x array<double>").selectExpr("rec_id", "timestamp_seconds(at) AS ts", "seq", "x")
    table.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def folders(spark):
    return [f"file://{tempfile.mkdtemp(prefix='spark-')}/{name}" for name in ("in", "out", "checkpoint")]


def labels(values, length=4, radius=1, base=1e-6):
    """Labels of the windows of a whole history."""
    means = [sum(values[: i + 1]) / (i + 1) for i in range(len(values))]
    n = max(0, (len(values) - 1) // length)
    energies = [sum(abs(values[i] - means[i]) for i in range(w * length, (w + 1) * length)) / length for w in range(n)]
    if not n:
        return []
    threshold = math.exp(sum(math.log(e + base) for e in energies) / n)
    mask = [int(e > threshold) for e in energies]
    for f in (max, min, min, max):
        mask = [f(mask[max(0, w - radius) : w + radius + 1]) for w in range(n)]
    return mask


def test_labels_are_revised_and_survive_restarts(spark, folders):
    """Loudness changes, so the threshold moves over windows of long ago; the query is stopped and started between the files."""
    r = random.Random(3)
    values = {c: [r.gauss(0, [0.1, 3.0, 0.5, 9.0][i // 150 % 4] * (1 + r.random())) for i in range(600)] for c in (1, 2)}
    rows = [(c, 100 + i, i, [v]) for c in values for i, v in enumerate(values[c])]
    said = 0
    for k in range(3):
        part = [x for x in rows if 200 * k <= x[2] < 200 * (k + 1)]
        late = [x for x in part if x[2] % 50 == 49]  # comes with the next file
        if k:
            part += held
        held = late
        put(spark, folders[0], [x for x in part if x not in late] if k < 2 else part)
        out = stateful.run_available(stateful.speech_labels(stream(spark, folders[0]), 4, 1, late="300 seconds", idle_ms=10**7), *folders[1:])
        assert out.count() >= said
        said = out.count()
    put(spark, folders[0], [(-1, 10**6, 0, None)])
    out = stateful.run_available(stateful.speech_labels(stream(spark, folders[0]), 4, 1, late="300 seconds", idle_ms=10**7), *folders[1:])
    found = {(x.rec_id, x.win): x.speech for x in stateful.latest_labels(out).collect()}
    assert found == {(c, w): s for c in values for w, s in enumerate(labels(values[c]))}
    assert out.count() > len(found)  # some were said again
    assert out.groupBy("rec_id", "win", "version").count().filter("count > 1").isEmpty()


def test_a_source_that_ends_begins_anew(spark, folders):
    rng = np.random.default_rng(1)
    first, second = rng.standard_normal((7, 3)), rng.standard_normal((2, 3))
    put(spark, folders[0], [(5, 10 + i, i, x.tolist()) for i, x in enumerate(first)])
    put(spark, folders[0], [(5, 5000 + i, i, x.tolist()) for i, x in enumerate(second)])
    put(spark, folders[0], [(-1, 90_000, 0, None)])
    out = stateful.run_available(stateful.regression_delta(stream(spark, folders[0]), 5, late="1 second", idle_ms=60_000), *folders[1:])
    want = []
    for block in (first, second):
        n = len(block)
        at = lambda i: block[min(max(i, 0), n - 1)]  # noqa: B023, E731
        want += [(t, sum(j * (at(t + j) - at(t - j)) for j in (1, 2)) / 10) for t in range(n)]
    found = sorted(out.collect(), key=lambda x: (x.frame_idx, x.x))
    assert len(found) == len(want)
    for a, (t, x) in zip(found, sorted(want, key=lambda w: (w[0], w[1].tolist())), strict=True):
        assert a.frame_idx == t and np.allclose(a.x, x, atol=1e-12)


def test_rows_that_are_too_late_are_left_out(spark, folders):
    put(spark, folders[0], [(1, 1000 + i, i, [float(i)]) for i in range(5)])
    put(spark, folders[0], [(1, 2000, 5, [5.0])])
    put(spark, folders[0], [(1, 1, 99, [99.0]), (-1, 10**6, 0, None)])
    out = stateful.run_available(stateful.trajectories(stream(spark, folders[0]), 2, late="10 seconds", idle_ms=10**7), *folders[1:])
    assert sorted(tuple(x.x) for x in out.collect()) == [(float(i), float(i + 1)) for i in range(5)]


def test_a_batch_that_runs_twice_counts_once(spark):
    folder = fresh_folder(spark, "twice")
    sink = stateful.committed(folder)
    for number in (0, 1, 1, 0):
        sink(spark.range(number * 10, number * 10 + 3), number)
    assert sorted(r.id for r in spark.read.parquet(folder).collect()) == [0, 1, 2, 10, 11, 12]


def test_committed_batches_after_a_restart(spark, folders):
    from cadenza import streaming

    put(spark, folders[0], [(1, 10, 0, [1.0]), (2, 11, 1, [5.0])])

    def run():
        events = stream(spark, folders[0]).selectExpr("rec_id AS user_id", "x[0] AS value")
        return {x.user_id: (x.n, x["mean"]) for x in stateful.run_committed(streaming.running_statistics(events), "complete", *folders[1:]).collect()}

    assert run() == {1: (1, 1.0), 2: (1, 5.0)}
    put(spark, folders[0], [(1, 12, 2, [3.0])])
    assert run() == run() == {1: (2, 2.0), 2: (1, 5.0)}


def test_only_row(spark):
    two = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    assert only_row(two.filter("n = 1"), "x").collect() == two.filter("n = 1").collect()
    assert only_row(two.filter("n = 3"), "x").count() == 0
    with pytest.raises(Exception, match="one row is needed"):
        only_row(two, "x").collect()


class _Fake:
    """A state in memory that counts what is fetched and stored."""

    def __init__(self):
        self.values, self.fetched, self.stored = {}, 0, 0

    def containsKey(self, key):
        return key in self.values

    def getValue(self, key):
        self.fetched += 1
        return self.values[key]

    def updateValue(self, key, value):
        self.stored += 1
        self.values[key] = value

    def exists(self):
        return "v" in self.values

    def get(self):
        return self.values["v"]

    def update(self, value):
        self.values["v"] = value

    def clear(self):
        self.values.clear()


def test_entries_are_fetched_and_stored_once_a_step():
    import numpy as np

    from cadenza.streaming.stateful import _Speech

    class Handle:
        made = []

        def getValueState(self, *_):
            return _Fake()

        def getMapState(self, *_):
            self.made.append(_Fake())
            return self.made[-1]

    speech = _Speech(5, 2, 1e-6, 1000)
    speech.open(Handle())
    x = np.random.default_rng(6).exponential(50, (601, 1))
    for a, b in ((0, 301), (301, 601)):
        assert len(speech.step(x[a:b], False)) >= (b - a) // 5 - 1
    energies, labels = Handle.made
    assert labels.fetched == 1 and labels.stored == 2 and energies.fetched <= len(energies.values) and energies.stored <= 2 * len(energies.values)


def test_frames_are_handed_on_in_blocks():
    import numpy as np

    from cadenza.streaming.stateful import _LookAhead

    sizes = []

    def kernel(b, n):
        sizes.append(n)
        return b[2 : 2 + n] - b[:n]

    ahead = _LookAhead(kernel, 0, 2, False, 1000)
    ahead.tail = _Fake()
    x = np.random.default_rng(8).normal(0, 1, (3000, 4))
    out = [r for a, b, ended in ((0, 1700, False), (1700, 3000, True)) for r in ahead.step(x[a:b], ended)]
    assert max(sizes) <= ahead.BLOCK and [i for i, _ in out] == list(range(2998)) and np.array_equal(np.array([v for _, v in out]), x[2:] - x[:-2])
