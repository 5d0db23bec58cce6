"""Spectral operators on frames: vectorised functions over Arrow batches of equally long frames.

Each takes a column of array<double> and gives one; a batch's frames of one length are transformed as matrices, in slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOUBLES = "array<double>"
FLOOR = 1e-6
#: Values of frames, or of spectra of 1,024 values, that are transformed at once.
SLICE = 1 << 19


def _lengths(frames: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, frames of that length as a matrix) in slices of a bounded number of values; null frames are in none."""
    at, values = np.asarray(frames.offsets), np.asarray(frames.values.to_numpy(zero_copy_only=False), np.float64)
    sizes = np.where(np.asarray(frames.is_valid()), np.diff(at), -1)
    for n in np.unique(sizes[sizes >= 0]).tolist():
        rows, step = np.flatnonzero(sizes == n), max(1, SLICE // max(n, 1024))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield n, part, values[at[part][:, None] + np.arange(n)]


def _batched(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A column function from one on matrices (a frame per row); null frames stay null.

    Frames are transformed by slices, from Arrow's own buffer into another: what a task holds beside a batch and its results is bounded.
    """

    @F.arrow_udf(DOUBLES)
    def run(frames: pa.Array) -> pa.Array:
        done = [(rows, f(m) if n else np.zeros((len(rows), 0))) for n, rows, m in _lengths(frames)]
        widths = np.zeros(len(frames) + 1, np.int32)
        for rows, m in done:
            widths[rows + 1] = m.shape[1]
        at = np.cumsum(widths, dtype=np.int32)
        values = np.empty(at[-1])
        while done:
            rows, m = done.pop()
            values[at[rows][:, None] + np.arange(m.shape[1])] = m
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values), mask=pc.is_null(frames))

    return run


def dct_basis(n: int, rows: int | None = None) -> np.ndarray:
    """Rows of the orthonormal DCT-II."""
    j = np.arange(n if rows is None else rows)[:, None]
    basis = np.cos(np.pi * (np.arange(n)[None] + 0.5) * j / n) * math.sqrt(2.0 / n)
    basis[0] *= math.sqrt(0.5)
    return basis


def fft_size(frame: int, least: int = 512) -> int:
    """The power of two above the frame's length, at least ``least``."""
    return max(least, 1 << frame.bit_length())


def power_spectrum(x: Column, normalise: bool = False) -> Column:
    """Magnitude at bin 0 and squared magnitudes elsewhere of the zero-padded frame; scaled to a sum of 1 if ``normalise``."""

    def run(m: np.ndarray) -> np.ndarray:
        size = np.abs(np.fft.rfft(m, fft_size(m.shape[1]), axis=1))
        out = np.concatenate([size[:, :1], size[:, 1:] ** 2], axis=1)
        return out / np.maximum(out.sum(1, keepdims=True), np.finfo(float).tiny) if normalise else out

    return _batched(run)(x)


def hartley_transform(x: Column) -> Column:
    def run(m: np.ndarray) -> np.ndarray:
        f = np.fft.fft(m, axis=1)
        return f.real - f.imag

    return _batched(run)(x)


def mel(f: np.ndarray | float) -> np.ndarray | float:
    return 1127.0 * np.log1p(np.asarray(f) / 700.0)


def hertz(m: np.ndarray | float) -> np.ndarray | float:
    return 700.0 * np.expm1(np.asarray(m) / 1127.0)


@dataclass(frozen=True)
class MelBank:
    """A bank of triangular filters, equally wide and spaced on the mel scale.

    ``overlap`` is the wanted distance of neighbours as a share of the width; the number of filters is what covers the range,
    rounded up, and the distance is adjusted to it. Edges beyond the last bin collapse on it.
    """

    rate: float = 8000.0
    fft: int = 512
    low: float = 188.0
    high: float = 6071.0
    width: float = 226.79982
    overlap: float = 0.5
    least: int = 0

    def weights(self) -> np.ndarray:
        bottom, top = float(mel(self.low)), float(mel(self.high))
        count = max(self.least, math.ceil((top - bottom - self.width) / (self.width * self.overlap) + 1 - 1e-9))
        step = (top - bottom - self.width) / max(1, count - 1)
        bins, unit = self.fft // 2 + 1, self.rate / self.fft
        rows = np.zeros((count, bins))
        for i in range(count):
            a = bottom + i * step
            left, right = (min(bins - 1, round(float(hertz(e)) / unit)) for e in (a, a + self.width))
            n = right - left + 1
            place = np.arange(n)
            triangle = 1.0 - np.abs((place - (n - 1) / 2) / ((n + 1) / 2))
            rows[i, left : right + 1] = triangle / triangle.sum()
        return rows


def window_weights(kind: str, n: int) -> np.ndarray:
    """Weights of a window of ``n`` samples. The triangular one rises to 1 in its first half and falls to 0 at its end; n is even there."""
    i = np.arange(n)
    if kind == "rectangular":
        return np.ones(n)
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(2 * np.pi * i / (n - 1))
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1))
    if kind == "triangular":
        half = n // 2
        return np.where(i < half, 2.0 * (i + 1) / n, np.where(i < 2 * half, 2.0 * (2 * half - 1 - i) / n, 0.0))
    raise ValueError(f"unknown window {kind}")


def resolution(rate: float, frame: int) -> float:
    """Hertz between the bins of a frame's spectrum."""
    return rate / fft_size(frame, 1)


def filter_weights(spec: str, bins: int, unit: float) -> np.ndarray:
    """[filter, bin] of a specification ``type,shape,start,end:...``: mel (m) or hertz (f), rectangular (r) or triangular (t).

    Each row sums to 1. ``unit`` is the distance of the bins in hertz; ends beyond the bins collapse on the nearest.
    """
    rows = []
    for part in spec.strip().split(":"):
        fields = part.split(",")
        if len(fields) != 4 or fields[0] not in ("m", "f") or fields[1] not in ("r", "t"):
            raise ValueError(f"not a filter <m|f>,<r|t>,<start>,<end>: {part}")
        low, high = float(fields[2]), float(fields[3])
        left, center, right = (min(bins - 1, max(0, math.floor(float(hertz(v) if fields[0] == "m" else v) / unit + 0.5))) for v in (low, low + (high - low) / 2, high))
        at = np.arange(bins)
        up, down = (at - left + 1) / (center - left + 1), 1 - (at - center) / (right - center + 1)
        shape = np.ones(bins) if fields[1] == "r" else np.where(at <= center, up, down)
        row = np.where((at >= left) & (at <= right), shape, 0.0)
        rows.append(row / row.sum())
    return np.array(rows)


def filter_bank(spectrum: Column, weights: np.ndarray, log: bool = True) -> Column:
    """Filter outputs, ``log(v + 1e-6)`` if ``log``."""

    def run(m: np.ndarray) -> np.ndarray:
        out = m @ weights.T
        return np.log(out + FLOOR) if log else out

    return _batched(run)(spectrum)


def cepstrum(x: Column, bank: MelBank | None = None, coefficients: int = 19) -> Column:
    """Mel cepstral coefficients; the first is replaced by the logarithm of the raw spectral energy."""
    bank = bank or MelBank()
    weights = bank.weights()
    basis = dct_basis(len(weights), coefficients)

    def run(m: np.ndarray) -> np.ndarray:
        n = m.shape[1]
        window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1))
        size = np.abs(np.fft.rfft(m * window, bank.fft, axis=1))
        spectrum = np.concatenate([size[:, :1], size[:, 1:] ** 2], axis=1)
        out = np.log(spectrum @ weights.T + FLOOR) @ basis.T
        out[:, 0] = np.log(spectrum.sum(1) + FLOOR)
        return out

    return _batched(run)(x)


def fft_autocorrelation(x: Column) -> Column:
    """Autocorrelation by FFT, scaled to 1 at lag 0; the first half, divided by that of a Hamming window."""

    def acf(m: np.ndarray) -> np.ndarray:
        n = m.shape[1]
        out = np.fft.irfft(np.abs(np.fft.rfft(m, 2 * n, axis=1)) ** 2, axis=1)[:, : n // 2]
        return out / np.where(out[:, :1] > 0, out[:, :1], 1.0)

    def run(m: np.ndarray) -> np.ndarray:
        n = m.shape[1]
        window = (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1)))[None]
        return acf(m) / acf(window)

    return _batched(run)(x)


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(prediction coefficients with a leading 1, residual energies) of rows of autocorrelations."""
    a = np.zeros((len(r), order + 1))
    a[:, 0] = 1.0
    error = r[:, 0].copy()
    for i in range(1, order + 1):
        reach = (a[:, :i] * r[:, i:0:-1]).sum(1)
        k = np.where(error > 0, -reach / np.where(error > 0, error, 1.0), 0.0)
        a[:, 1 : i + 1] += k[:, None] * a[:, i - 1 :: -1][:, :i]
        error = error * (1 - k * k)
    return a, error


def lpc_spectrum(x: Column, order: int = 14, size: int = 512) -> Column:
    """Spectrum of the all-pole model of ``order``."""

    def run(m: np.ndarray) -> np.ndarray:
        n = m.shape[1]
        r = np.fft.irfft(np.abs(np.fft.rfft(m, 2 * n, axis=1)) ** 2, axis=1)[:, : order + 1]
        a, error = levinson(r, order)
        return np.maximum(error, 0)[:, None] / np.maximum(np.abs(np.fft.rfft(a, size, axis=1)) ** 2, np.finfo(float).tiny)

    return _batched(run)(x)


def formants(spectrum: Column, rate: float, count: int, size: int = 512) -> Column:
    """Frequencies of the first ``count`` local maxima, low to high; 0 where there are fewer."""
    from cadenza.operators.sequence import local_maxima

    found = F.transform(F.slice(local_maxima(spectrum), 1, count), lambda i: i * (rate / size))
    return F.slice(F.concat(found, F.array_repeat(F.lit(0.0), count)), 1, count)


def f0_candidates(acf: Column, rate: float, count: int, low: float = 50.0, high: float = 600.0) -> Column:
    """The ``count`` best pitch candidates, ascending by autocorrelation: the best is last; 0 where there are fewer."""
    from cadenza.operators.sequence import local_maxima

    lags = F.filter(local_maxima(acf), lambda i: (i >= rate / high) & (i <= rate / low))
    ranked = F.array_sort(F.transform(lags, lambda i: F.struct(F.element_at(acf, i + 1).alias("v"), (F.lit(rate) / i).alias("f"))))
    best = F.transform(F.slice(F.concat(F.array_repeat(F.struct(F.lit(float("-inf")).alias("v"), F.lit(0.0).alias("f")), count), ranked), -count, count), lambda c: c["f"])
    return best


def voicing(x: Column, zero_crossings: float, energy: float, peak: float) -> Column:
    """1 or 0 before the frame: voiced if crossings are few and mean energy and peak are high enough.

    A crossing is a product of neighbours of -1 or less, which samples within [-1, 1] hardly ever have.
    """
    n = F.size(x)
    pairs = F.zip_with(F.slice(x, 1, n - 1), F.slice(x, F.lit(2), n - 1), lambda a, b: (a * b <= -1).cast("double"))
    rate = F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b) / n
    power = F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b) / n
    top = F.array_max(F.transform(x, F.abs))
    flag = ((rate <= zero_crossings) & (power >= energy) & (top >= peak)).cast("double")
    return F.concat(F.array(flag), x)


def yin_pitch(x: Column, rate: float = 8000.0, threshold: float = 0.15) -> Column:
    """Pitch of each frame by YIN in single precision, -1 if unvoiced (also for constant frames). Frames of one length go together."""

    @F.arrow_udf("double")
    def run(frames: pa.Array) -> pa.Array:
        out = np.zeros(len(frames))
        for _, rows, m in _lengths(frames):
            out[rows] = yin_rows(m.astype(np.float32), rate, threshold)
        return pa.array(out, mask=np.asarray(pc.is_null(frames)))

    return run(x)


def yin_rows(frames: np.ndarray, rate: float, threshold: float = 0.15) -> np.ndarray:
    """Pitches of frames of one length, in slices whose differences take about 16 MB."""
    half = frames.shape[1] // 2
    if half < 4:
        return np.full(len(frames), -1.0)
    step = max(1, (4 << 20) // (half * half))
    return np.concatenate([_yin(frames[a : a + step], half, rate, threshold) for a in range(0, len(frames), step)]) if len(frames) else np.zeros(0)


def _yin(frames: np.ndarray, half: int, rate: float, threshold: float) -> np.ndarray:
    lagged = np.lib.stride_tricks.sliding_window_view(frames, half, axis=1)[:, :half]
    difference = ((frames[:, None, :half] - lagged) ** 2).sum(2, dtype=np.float32)
    running = np.cumsum(difference[:, 1:], axis=1, dtype=np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        normal = difference[:, 1:] * np.arange(1, half, dtype=np.float32) / running
    normal = np.concatenate([np.ones((len(frames), 1), np.float32), normal], axis=1)
    lags, every = np.arange(half), np.arange(len(frames))
    below = (normal < threshold) & (lags >= 2)
    first = below.argmax(1)
    # From the first lag below the threshold on to where the next one is not lower.
    ends = np.ones(normal.shape, bool)
    ends[:, :-1] = ~(normal[:, 1:] < normal[:, :-1])
    tau = (ends & (lags >= first[:, None])).argmax(1)
    a, b, c = (normal[every, np.clip(tau + i, 0, half - 1)].astype(np.float64) for i in (-1, 0, 1))
    bend = 2 * (2 * b - c - a)
    inner = (tau >= 1) & (tau < half - 1) & (bend != 0)
    shift = np.where(inner, (c - a) / np.where(bend != 0, bend, 1.0), 0.0)
    return np.where(below.any(1), rate / np.maximum(tau + shift, 1e-9), -1.0)


def yin(frame: np.ndarray, rate: float, threshold: float = 0.15) -> float:
    """The pitch of one frame."""
    return float(yin_rows(np.asarray(frame, np.float32)[None], rate, threshold)[0])


def feature_frames(framed: DataFrame, bank: MelBank | None = None, coefficients: int = 19) -> DataFrame:
    """rec_id, frame_idx, x: the cepstral coefficients of framed samples."""
    return framed.withColumn("x", cepstrum(F.col("x"), bank, coefficients))
