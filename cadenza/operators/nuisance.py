"""Directions of nuisance from weights between pairs of frames, without a matrix of pairs.

For symmetric weights w the scatter ``1/2 sum w[i, j] (x_i - x_j)(x_i - x_j)'`` is the sum of signed squares of few kinds of rows, since
the weights surveyed are 1 between frames of different channels, or between those of one place in different channels:
each frame times the number of its partners, less the sum of all, plus the sum of each channel; or less the sum of each place.
So a table (w, x) as long as the frames and groups stands for it, and its leading directions are found from sums over that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widest x whose d by d scatter is added up in the tasks; wider ones go by subspace iteration.
WIDEST = 2048
#: Bytes of directions that go to every task.
BASIS_BYTES = 256 << 20


def _summed(frames: DataFrame, *keys: str | Column) -> DataFrame:
    """The keys, n and x: the sum of the frames of each group, place by place, so that no group is gathered."""
    names = [f"_g{i}" for i in range(len(keys))]
    places = frames.select(*[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)], F.posexplode("x").alias("at", "v"))
    each = places.groupBy(*names, "at").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    return each.groupBy(*names).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("x"))


def channel_rows(frames: DataFrame, channel: str) -> DataFrame:
    """w, x of the scatter between frames of different channels (null is a channel). Frames without x are left out."""
    frames = frames.filter("x is not null")
    sizes = frames.groupBy(F.col(channel).alias("_c")).agg(F.count("*").alias("_n"))
    total = frames.agg(F.count("*").alias("_t"))
    joined = frames.join(sizes, F.col(channel).eqNullSafe(F.col("_c"))).crossJoin(F.broadcast(total))  # one row
    each = joined.select((F.col("_t") - F.col("_n")).cast("double").alias("w"), "x")
    whole = _summed(frames).filter("n > 0").select(F.lit(-1.0).alias("w"), "x")
    return each.unionByName(whole).unionByName(_summed(frames, channel).select(F.lit(1.0).alias("w"), "x"))


def session_rows(frames: DataFrame, channel: str, place: str, ragged: bool = False) -> DataFrame:
    """w, x of the scatter between frames of one place in different channels, each of which has one frame a place.

    Channels of different lengths raise, as do two frames of one channel and place; with ``ragged`` a place counts the channels that have it.
    Frames without x, channel or place are left out.
    """
    frames = frames.filter(F.col("x").isNotNull() & F.col(channel).isNotNull() & F.col(place).isNotNull())
    channels, twice = frames.groupBy(channel, place).agg(F.count("*").alias("_k")), F.lit("two frames of one channel and place")
    at_place = channels.groupBy(F.col(place).alias("_p")).agg(F.count("*").alias("_n"), F.max("_k").alias("_k"))
    n = F.when(F.col("_k") > 1, F.raise_error(twice).cast("long"))
    if not ragged:
        most = channels.select(channel).distinct().agg(F.count("*").alias("_t"))
        at_place = at_place.crossJoin(F.broadcast(most))  # one row
        n = n.when(F.col("_n") != F.col("_t"), F.raise_error(F.lit("channels differ in length")).cast("long"))
    at_place = at_place.select("_p", n.otherwise(F.col("_n")).alias("_n"))
    each = frames.join(at_place, F.col(place) == F.col("_p")).select(F.col("_n").cast("double").alias("w"), "x")
    return each.unionByName(_summed(frames, place).select(F.lit(-1.0).alias("w"), "x"))


def scatter(rows: DataFrame) -> np.ndarray:
    """[d, d] sum of w x x'; a task sends one packed triangle."""
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    low = np.tril_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width))
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, width) if width else np.zeros((0, 0))
            out += (x * np.asarray(batch.column(0))[: len(x), None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low[0]))), pa.array(out[low])], ["i", "v"])

    out = np.zeros((width, width))
    for r in rows.select("w", "x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[low[0][r["i"]], low[1][r["i"]]] = out[low[1][r["i"]], low[0][r["i"]]] = r["v"]
    return out


def _times(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """scatter(rows) @ basis, [d, k], without the scatter: a task sends d rows of k sums."""
    d, k = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, k))
        for batch in batches:
            step = max(1, (8 << 20) // (8 * d))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.asarray(part.column(1).flatten(), np.float64).reshape(-1, d)
                out += x.T @ (np.asarray(part.column(0))[:, None] * (x @ basis))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), *[pa.array(out[:, j]) for j in range(k)]], ["i", *[f"v{j}" for j in range(k)]])

    found = rows.select("w", "x").mapInArrow(run, ", ".join(["i long", *[f"v{j} double" for j in range(k)]]))
    out = np.zeros((d, k))
    for r in found.groupBy("i").agg(*[F.sum(f"v{j}") for j in range(k)]).collect():  # the size of the basis
        out[r[0]] = r[1:]
    return out


def directions(rows: DataFrame, rank: int, widest: int = WIDEST, turns: int = 100, extra: int = 8, tolerance: float = 1e-9, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """([rank, d] leading directions of the scatter of (w, x), their values), largest first; fewer where x is narrower.

    Up to ``widest`` components by the scatter itself. Wider ones, also where frames are fewer than components, by subspace iteration
    with ``extra`` directions more, until no value moves by ``tolerance`` of the largest in a turn: neither frames by frames nor
    d by d is ever held, and a turn is one pass over the rows. Give a table that is written, or a cheap one.
    """
    if rank < 1:
        raise ValueError("rank is 1 or more")
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return np.zeros((0, 0)), np.zeros(0)
    if d <= widest:
        values, vectors = np.linalg.eigh(scatter(rows))
        order = np.argsort(-values)[:rank]
        return vectors[:, order].T, values[order]
    k = min(d, rank + extra)
    if 8 * d * k > BASIS_BYTES:
        raise ValueError(f"directions of {8 * d * k} bytes; at most {BASIS_BYTES} go to every task")
    basis, before = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, k)))[0], np.zeros(k)
    for _ in range(turns):
        moved = _times(rows, basis)
        values, turn = np.linalg.eigh((basis.T @ moved + moved.T @ basis) / 2)
        order = np.argsort(-values)
        values, found = values[order], basis @ turn[:, order]
        if np.abs(values - before)[:rank].max() <= tolerance * max(abs(values[0]), 1e-300):
            break
        before, basis = values, np.linalg.qr(moved @ turn[:, order])[0]
    return found[:, :rank].T, values[:rank]
