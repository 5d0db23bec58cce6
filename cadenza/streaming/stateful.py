"""Operators on streams that look ahead or change what they said: ordered state, event-time timers, labels by version.

Rows have a source (rec_id), an event time (ts) and a number that orders rows of one time (seq). A row is worked on once the watermark
has passed it, so rows may come late and in any batch; a row without x only moves the clock. A source that is silent for ``idle`` has ended: what needed rows to come is
flushed, and later rows begin anew.
"""

from __future__ import annotations

import contextlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that these operators need, while a query with them is started."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_available(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Appends what a stream gives for all files that are there to ``folder`` (each batch once, also after a restart), and reads it."""
    with keyed_state(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


class _InOrder(StatefulProcessor):
    """Hands the rows of a source on in the order of (ts, seq): ``step(rows, ended)`` gets them when no earlier one can come."""

    BLOCK = 512  # rows that are worked on or handed over at once

    def __init__(self, idle_ms: int, columns: list[str]) -> None:
        self.idle, self.columns = idle_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, x array<double>")
        self.done = handle.getValueState("done", "at long")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues):
        newest = None
        for part in rows:
            got = [(int(a), int(s), [float(v) for v in x]) for a, s, x in zip(part["at"], part["seq"], part["x"], strict=True) if x is not None]
            if got:
                self.waiting.appendList(got)
                newest = max(r[0] for r in got) if newest is None else max(newest, *(r[0] for r in got))
        if newest is None:
            return iter(())
        newest = newest // 1000 + 1
        self.handle.registerTimer(newest)
        self.handle.registerTimer(newest + self.idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out: list[tuple] = []
        for row in self._handed_on(timerValues.getCurrentWatermarkInMs()):
            out.append((key[0], *row))
            if len(out) == self.BLOCK:
                yield pd.DataFrame(out, columns=self.columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def _handed_on(self, now: int) -> Iterator[tuple]:
        rows = sorted((r[0], r[1], array("d", r[2])) for r in self.waiting.get())
        ready = [r for r in rows if r[0] // 1000 < now]
        if ready:
            self.waiting.clear()
            if len(ready) < len(rows):
                self.waiting.put([(at, seq, x.tolist()) for at, seq, x in rows[len(ready) :]])
        last, run = self.done.get()[0] if self.done.exists() else None, []
        for row in ready:
            if last is not None and row[0] - last > self.idle * 1000:  # the source had ended before this row
                yield from self.step(np.array([r[2] for r in run], np.float64), True)
                run = []
            run.append(row)
            last = row[0]
        if last is None:
            return
        ended = last // 1000 + self.idle < now
        if run or ended:
            yield from self.step(np.array([r[2] for r in run], np.float64), ended)
        self.done.clear() if ended else self.done.update((last,))

    def close(self) -> None:
        pass


class _LookAhead(_InOrder):
    """Applies a kernel to each frame with ``back`` frames before and ``ahead`` after it.

    State holds the frames that later outputs need, at most ``back + ahead``. Before the first frame there are copies of it; after the
    last there are copies if ``pad``, else frames without all that follow give nothing.
    """

    def __init__(self, kernel: Callable[[np.ndarray, int], np.ndarray], back: int, ahead: int, pad: bool, idle_ms: int) -> None:
        super().__init__(idle_ms, ["rec_id", "frame_idx", "x"])
        self.kernel, self.back, self.ahead, self.pad = kernel, back, ahead, pad

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "done long, width int, flat array<double>")

    def step(self, rows: np.ndarray, ended: bool) -> Iterator[tuple]:
        if self.tail.exists():
            done, width, flat = self.tail.get()
            held = np.array(flat, np.float64).reshape(-1, width)
            held = np.concatenate([held, rows]) if len(rows) else held
        else:
            done, width = 0, rows.shape[1]
            held = np.concatenate([np.repeat(rows[:1], self.back, 0), rows])
        if ended and self.pad:
            held = np.concatenate([held, np.repeat(held[-1:], self.ahead, 0)])
        n = max(0, len(held) - self.back - self.ahead)
        for i in range(0, n, self.BLOCK):
            size = min(self.BLOCK, n - i)
            for j, x in enumerate(self.kernel(held[i : i + size + self.back + self.ahead], size)):
                yield done + i + j, x
        if ended:
            self.tail.clear()
        else:
            self.tail.update((done + n, width, held[n:].ravel().tolist()))


def _ordered(stream: DataFrame, processor: StatefulProcessor, late: str, schema: str) -> DataFrame:
    rows = stream.withWatermark("ts", late).select("rec_id", "ts", F.unix_micros("ts").alias("at"), "seq", "x")
    return rows.groupBy("rec_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


_FRAME = "rec_id {}, frame_idx long, x array<double>"


def _frames(stream: DataFrame, kernel, back: int, ahead: int, pad: bool, late: str, idle_ms: int) -> DataFrame:
    return _ordered(stream, _LookAhead(kernel, back, ahead, pad, idle_ms), late, _FRAME.format(stream.schema["rec_id"].dataType.simpleString()))


def regression_delta(stream: DataFrame, context: int = 3, *, late: str, idle_ms: int) -> DataFrame:
    """rec_id, frame_idx, x: regression deltas of a stream of frames (rec_id, ts, seq, x), edges replicated."""
    if context < 3 or context % 2 == 0:
        raise ValueError("context must be odd and at least 3")
    half = context // 2

    def kernel(b: np.ndarray, n: int) -> np.ndarray:
        return sum(j * (b[half + j : half + j + n] - b[half - j : half - j + n]) for j in range(1, half + 1)) * (1.0 / (2 * sum(j * j for j in range(1, half + 1))))

    return _frames(stream, kernel, half, half, True, late, idle_ms)


def shifted_delta(stream: DataFrame, d: int = 1, p: int = 3, k: int = 7, *, late: str, idle_ms: int) -> DataFrame:
    """rec_id, frame_idx, x: k differences ``x[t + ip + d + 1] - x[t + ip]`` side by side; frames without all of them give nothing."""

    def kernel(b: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([b[i * p + d + 1 : i * p + d + 1 + n] - b[i * p : i * p + n] for i in range(k)], 1)

    return _frames(stream, kernel, 0, (k - 1) * p + d + 1, False, late, idle_ms)


def trajectories(stream: DataFrame, context: int, *, late: str, idle_ms: int) -> DataFrame:
    """rec_id, frame_idx, x: for each band its values in ``context`` following frames, band after band."""

    def kernel(b: np.ndarray, n: int) -> np.ndarray:
        return np.stack([b[j : j + n] for j in range(context)], 2).reshape(n, -1)

    return _frames(stream, kernel, 0, context - 1, False, late, idle_ms)


def smooth_voicing(stream: DataFrame, *, late: str, idle_ms: int) -> DataFrame:
    """rec_id, frame_idx, x: flags (x[0], 0 or 1) without voiced runs shorter than 3 and unvoiced gaps of one frame; edges replicated."""

    def kernel(b: np.ndarray, n: int) -> np.ndarray:
        a, before, at, after, z = (b[j : j + n, 0] == 1 for j in range(5))
        in_run = (a & before) | (before & after) | (after & z)
        return np.where(at, in_run, before & after).astype(np.float64)[:, None]

    return _frames(stream, kernel, 2, 2, True, late, idle_ms)


def _extended(mask: np.ndarray, radius: int, most: bool) -> np.ndarray:
    """Largest (or smallest) value within ``radius`` places."""
    wide = np.pad(mask, radius, constant_values=not most)
    near = np.lib.stride_tricks.sliding_window_view(wide, 2 * radius + 1)
    return near.max(1) if most else near.min(1)


class _Held:
    """A map state of two lists a key: while a source is worked on, each entry is fetched once and stored once, if it has changed."""

    def __init__(self, state) -> None:
        self.state, self.known, self.touched = state, {}, set()

    def get(self, key: int) -> list[list]:
        if key not in self.known:
            self.known[key] = [list(x) for x in self.state.getValue((key,))] if self.state.containsKey((key,)) else [[], []]
        return self.known[key]

    def changed(self, key: int) -> list[list]:
        self.touched.add(key)
        return self.get(key)

    def store(self) -> None:
        for key in self.touched:
            self.state.updateValue((key,), tuple(self.known[key]))
        self.known, self.touched = {}, set()

    def clear(self) -> None:
        self.state.clear()
        self.known, self.touched = {}, set()


class _Speech(_InOrder):
    """Labels windows of samples as speech by a threshold over all windows so far, and says again what a moved threshold changes.

    State: the samples of the unfinished window and sums for means and threshold; windows by the stretch of energies they lie in, of which
    only those between the old and the new threshold are looked at; labels in chunks, raw and smoothed.
    """

    STRETCH, CHUNK = 16.0, 256

    def __init__(self, length: int, radius: int, base: float, idle_ms: int) -> None:
        super().__init__(idle_ms, ["rec_id", "win", "speech", "version"])
        self.length, self.radius, self.base = length, radius, base

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "samples long, total double, windows long, logs double, version long, rest array<double>, parts array<double>")
        self.by_energy = _Held(handle.getMapState("by_energy", "stretch long", "wins array<bigint>, energies array<double>"))
        self.labels = _Held(handle.getMapState("labels", "chunk long", "raw array<int>, smooth array<int>"))

    def _stretch(self, energy: float) -> int:
        return int(np.floor(np.log2(energy + self.base) * self.STRETCH))

    def _crossed(self, low: float, high: float) -> list[tuple[int, float]]:
        """Windows whose energy is in (low, high]."""
        out = []
        for s in range(self._stretch(low), self._stretch(high) + 1):
            out += [(w, e) for w, e in zip(*self.by_energy.get(s), strict=True) if low < e <= high]
        return out

    def _read(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(raw, smoothed) labels of windows a to b - 1; -1 where there is none yet."""
        raw, smooth = np.full(b - a, -1), np.full(b - a, -1)
        for c in range(a // self.CHUNK, (b - 1) // self.CHUNK + 1):
            left, at = max(a, c * self.CHUNK), c * self.CHUNK
            for out, values in zip((raw, smooth), self.labels.get(c), strict=True):
                part = np.array(values[left - at : b - at], np.int64)
                out[left - a : left - a + len(part)] = part
        return raw, smooth

    def _write(self, a: int, values: np.ndarray, which: int) -> None:
        for c in range(a // self.CHUNK, (a + len(values) - 1) // self.CHUNK + 1):
            both = self.labels.changed(c)
            for w in range(max(a, c * self.CHUNK), min(a + len(values), (c + 1) * self.CHUNK)):
                place = w - c * self.CHUNK
                for x in both:
                    x += [-1] * (place + 1 - len(x))
                both[which][place] = int(values[w - a])

    def step(self, rows: np.ndarray, ended: bool) -> list[tuple]:
        count, total, windows, logs, version, rest, parts = self.sums.get() if self.sums.exists() else (0, 0.0, 0, 0.0, 0, [], [])
        before = float(np.exp(logs / windows)) if windows else None
        fresh = rows[:, 0] if len(rows) else np.zeros(0)
        means = (total + np.cumsum(fresh)) / (count + np.arange(1, len(fresh) + 1))
        # A window is finished by the sample after it.
        values, sizes = np.concatenate([rest, fresh]), np.concatenate([parts, np.abs(fresh - means)])
        n = max(0, len(values) - 1) // self.length
        energies = sizes[: n * self.length].reshape(n, self.length).sum(1) / self.length
        logs += float(np.log(energies + self.base).sum())
        out = self._relabelled(windows, energies, before, float(np.exp(logs / (windows + n))) if windows + n else None, version)
        self.sums.update((count + len(fresh), total + float(fresh.sum()), windows + n, logs, version + 1, values[n * self.length :].tolist(), sizes[n * self.length :].tolist()))
        if ended:
            self.sums.clear()
        for state in (self.by_energy, self.labels):
            state.clear() if ended else state.store()
        return out

    def _relabelled(self, first: int, energies: np.ndarray, before: float | None, now: float | None, version: int) -> list[tuple]:
        changed: dict[int, int] = {}
        if before is not None and now != before:
            up = now > before
            changed = {w: 0 if up else 1 for w, _ in self._crossed(min(before, now), max(before, now))}
        for i, e in enumerate(energies.tolist()):
            s = self._stretch(e)
            for x, v in zip(self.by_energy.changed(s), (first + i, e), strict=True):
                x.append(v)
            changed[first + i] = int(e > now)
        last, reach, out = first + len(energies), 4 * self.radius, []
        for w, label in sorted(changed.items()):
            self._write(w, np.array([label]), 0)
        spans: list[list[int]] = []
        for w in sorted(changed):
            a, b = max(0, w - reach), min(last, w + reach + 1)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        for a, b in spans:
            left, right = max(0, a - reach), min(last, b + reach)
            raw, said = self._read(left, right)
            mask = raw == 1
            for most in (True, False, False, True):
                mask = _extended(mask, self.radius, most)
            now_said, old = mask[a - left : b - left].astype(int), said[a - left : b - left]
            self._write(a, now_said, 1)
            out += [(a + int(i), int(now_said[i]), version) for i in np.flatnonzero(now_said != old)]
        return out


def speech_labels(stream: DataFrame, length: int, radius: int = 2, base: float = 1e-6, *, late: str, idle_ms: int) -> DataFrame:
    """rec_id, win, speech, version: labels of windows of ``length`` samples (rec_id, ts, seq, x[0]); a later version replaces an earlier.

    A window is speech if its energy (mean distance from the mean of all samples so far) is above the geometric mean of all windows'
    energies so far; labels are closed and opened with ``radius``. :func:`latest_labels` gives what holds.
    """
    kind = stream.schema["rec_id"].dataType.simpleString()
    return _ordered(stream, _Speech(length, radius, base, idle_ms), late, f"rec_id {kind}, win long, speech int, version long")


def latest_labels(labels: DataFrame) -> DataFrame:
    """rec_id, win, speech as the last version has them."""
    return labels.groupBy("rec_id", "win").agg(F.max_by("speech", "version").alias("speech"))


def committed(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: a batch's rows under its number, so one that is run twice replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return sink


def run_committed(stream: DataFrame, mode: str, folder: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all files that are there into :func:`committed` batches, and reads them: in complete mode the last one."""
    spark = stream.sparkSession
    stream.writeStream.outputMode(mode).foreachBatch(committed(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    batches = spark.read.parquet(folder)
    if mode == "complete":
        batches = batches.filter(F.col("batch") == batches.agg(F.max("batch")).first()[0])
    return batches.drop("batch")
