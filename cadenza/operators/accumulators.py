"""Kept sufficient statistics of Gaussians by key, and full Gaussians from them.

A statistic is a row a key: n, s (sums of components), q (sums of products, packed: the rows of a lower triangle one after another). Tables
of it are added and taken away, so a model is refreshed from new rows, or freed from old ones, without reading the rest again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least variance of a component; share of its variance below which a pivot counts as none.
LEAST_VARIANCE, LEAST_PIVOT = 1e-10, 1e-10
#: Bytes of a model that goes to every task.
MODEL_BYTES = 64 << 20


def statistics(frames: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, n, s, q of frames (key, x): a task adds up what it has and sends a row a key. Frames without x are left out.

    A task holds the sums of the keys it meets; frames of one width are needed.
    """
    kind = frames.schema[key].dataType.simpleString()

    def run(batches):
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
            keys = batch.column(0).dictionary_encode()
            codes = np.asarray(keys.indices.fill_null(len(keys.dictionary)))
            names = [*keys.dictionary.to_pylist(), None]
            low = np.tril_indices(x.shape[1])
            for code in np.unique(codes):
                rows = x[codes == code]
                n, s, q = held.get(names[code], (0, 0.0, 0.0))
                held[names[code]] = n + len(rows), s + rows.sum(0), q + (rows.T @ rows)[low]
        if held:
            yield pa.RecordBatch.from_pylist([{"key": k, "n": n, "s": s.tolist(), "q": q.tolist()} for k, (n, s, q) in held.items()], pa.schema([("key", batch.schema.field(0).type), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))]))

    partial = frames.filter("x is not null").select(key, "x").mapInArrow(run, f"key {kind}, n long, s array<double>, q array<double>")
    return merged(partial.withColumnRenamed("key", key), key=key)


def merged(*tables: DataFrame, key: str = "rec_id", signs: tuple[int, ...] | None = None) -> DataFrame:
    """The sum of statistics, each times its sign; keys whose n is 0 then have no row."""
    signed = [t.select(key, (F.col("n") * sign).alias("n"), *[F.transform(c, lambda v: v * float(sign)).alias(c) for c in ("s", "q")]) for t, sign in zip(tables, signs or [1] * len(tables), strict=True)]
    rows = signed[0]
    for more in signed[1:]:
        rows = rows.unionByName(more)
    # Added place by place, so that only sums travel and no list of rows is gathered.
    places = rows.select(key, "n", F.size("s").alias("width"), F.posexplode(F.concat("s", "q")).alias("at", "v"))
    summed = places.groupBy(key, "at", "width").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    whole = summed.groupBy(key, "width").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("v"))
    return whole.filter("n <> 0").select(key, "n", F.slice("v", F.lit(1), F.col("width")).alias("s"), F.slice("v", F.col("width") + 1, F.size("v") - F.col("width")).alias("q"))


def without(whole: DataFrame, part: DataFrame, key: str = "rec_id") -> DataFrame:
    """Statistics of the rows of ``whole`` that are not in ``part``."""
    return merged(whole, part, key=key, signs=(1, -1))


@dataclass(frozen=True)
class FullGaussians:
    """Gaussians by key: means and packed lower Cholesky factors; ``diagonal`` marks those whose covariance had no factor."""

    keys: list
    means: np.ndarray
    factors: np.ndarray
    diagonal: np.ndarray

    @staticmethod
    def of(stats: DataFrame, key: str = "rec_id") -> FullGaussians:
        """From statistics: a model of as many rows as keys, which must fit into :data:`MODEL_BYTES`.

        NaN counts as 0, variances are at least :data:`LEAST_VARIANCE`; a covariance that isn't positive definite keeps its diagonal only.
        """
        size = stats.agg(F.sum(8 * (F.size("s") + F.size("q")))).first()[0] or 0
        if size > MODEL_BYTES:
            raise ValueError(f"a model of {size} bytes; at most {MODEL_BYTES} go to every task")
        rows = sorted(stats.collect(), key=lambda r: (r[key] is not None, r[key]))
        n = np.array([r["n"] for r in rows], np.float64)[:, None]
        means = np.nan_to_num(np.array([r["s"] for r in rows]) / n)
        d = means.shape[1]
        low = np.tril_indices(d)
        packed = np.nan_to_num(np.array([r["q"] for r in rows]) / n) - means[:, low[0]] * means[:, low[1]]
        ends = np.cumsum(np.arange(1, d + 1)) - 1  # where the diagonal is packed
        packed[:, ends] = np.maximum(packed[:, ends], LEAST_VARIANCE)
        factors, whole = packed_cholesky(packed, d)
        factors[~whole] = 0.0
        factors[np.ix_(~whole, ends)] = np.sqrt(packed[np.ix_(~whole, ends)])
        return FullGaussians([r[key] for r in rows], means, factors, ~whole)


def packed_cholesky(packed: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed lower factors of packed matrices [matrix, place], which of them are positive definite), all matrices together, row by row."""
    out, whole = np.zeros_like(packed), np.ones(len(packed), bool)
    begin = [i * (i + 1) // 2 for i in range(d)]
    for i in range(d):
        row = out[:, begin[i] : begin[i] + i + 1]
        for j in range(i):
            other = out[:, begin[j] : begin[j] + j + 1]
            row[:, j] = (packed[:, begin[i] + j] - (row[:, :j] * other[:, :j]).sum(1)) / other[:, j]
        pivot = packed[:, begin[i] + i] - (row[:, :i] ** 2).sum(1)
        whole &= pivot > LEAST_PIVOT * packed[:, begin[i] + i]
        row[:, i] = np.sqrt(np.where(whole, pivot, 1.0))
    return out, whole


def full_scores(frames: DataFrame, model: FullGaussians) -> DataFrame:
    """Adds scores: array of log densities under each Gaussian, in the order of the model's keys."""
    d = model.means.shape[1]
    begin = [i * (i + 1) // 2 for i in range(d)]
    half = [-float(np.log(f[[b + i for i, b in enumerate(begin)]]).sum()) - d / 2 * float(np.log(2 * np.pi)) for f in model.factors]
    columns = frames.columns

    def run(batches):
        at = columns.index("x")
        for batch in batches:
            x = np.asarray(batch.column(at).flatten(), np.float64).reshape(batch.num_rows, -1)
            scores = np.empty((len(x), len(model.means)))
            for k, (mean, factor) in enumerate(zip(model.means, model.factors, strict=True)):
                y = (x - mean).T.copy()  # solved in place, component by component
                for i, b in enumerate(begin):
                    y[i] = (y[i] - factor[b : b + i] @ y[:i]) / factor[b + i]
                scores[:, k] = half[k] - 0.5 * (y * y).sum(0)
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*columns, "scores"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema)
    return frames.mapInArrow(run, f"{fields}, scores array<double>")
