"""Sequence operators on frames (rec_id, frame_idx, x) and samples (rec_id, idx, value), by windows over each record."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import vectors as V


def frame_order() -> W:
    return W.partitionBy("rec_id").orderBy("frame_idx")


def sample_order() -> W:
    return W.partitionBy("rec_id").orderBy("idx")


def overlapped(samples: DataFrame, length: int, shift: int) -> DataFrame:
    """Frames of ``length`` samples every ``shift``: all full ones and one zero-padded (none if shift equals length and nothing is left).

    A sample goes to the ``length / shift`` frames that hold it, so records are split by frame and never gathered whole.
    """
    n = samples.groupBy("rec_id").agg(F.count("*").alias("n"))
    full = F.floor((F.col("n") - length) / shift) + 1
    frames = F.when(F.col("n") < length, 1).when((F.lit(length == shift)) & (F.col("n") % shift == 0), full).otherwise(full + 1)
    sized = n.select("rec_id", frames.cast("long").alias("frames"))
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - length) / shift) + 1)
    each = samples.join(sized, "rec_id").withColumn("frame_idx", F.explode(F.sequence(first, F.floor(F.col("idx") / shift)))).filter("frame_idx < frames")
    held = each.groupBy("rec_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct((F.col("idx") - F.col("frame_idx") * shift).alias("at"), "value"))).alias("cells"))
    values = F.transform("cells", lambda c: c["value"])
    return held.select("rec_id", "frame_idx", F.concat(values, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(values))).alias("x"))


def pre_emphasis(samples: DataFrame, a: float = 0.95) -> DataFrame:
    return samples.withColumn("value", F.col("value") - a * F.coalesce(F.lag("value").over(sample_order()), F.lit(0.0)))


def regression_delta(frames: DataFrame, context: int = 3, order: int = 1) -> DataFrame:
    """Regression deltas of odd ``context`` with replicated edges; order 2 is the delta of the delta."""
    if context < 3 or context % 2 == 0:
        raise ValueError("context must be odd and at least 3")
    half, w = context // 2, frame_order()
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = frames
    for _ in range(order):
        left, right = F.first("x").over(whole), F.last("x").over(whole)
        terms = None
        for j in range(1, half + 1):
            step = V.scale(V.sub(F.coalesce(F.lead("x", j).over(w), right), F.coalesce(F.lag("x", j).over(w), left)), float(j))
            terms = step if terms is None else V.add(terms, step)
        out = out.withColumn("x", V.scale(terms, 1.0 / (2 * sum(j * j for j in range(1, half + 1)))))
    return out


def shifted_delta(frames: DataFrame, d: int = 1, p: int = 3, k: int = 7, copy: bool = False) -> DataFrame:
    """k differences ``x[t + ip + d + 1] - x[t + ip]`` side by side; rows without all of them are dropped and the rest renumbered."""
    w = frame_order()
    parts = [V.sub(F.lead("x", i * p + d + 1).over(w), F.lead("x", i * p).over(w) if i else F.col("x")) for i in range(k)]
    if copy:
        parts = [F.lead("x", ((k - 1) * p + d + 1) // 2).over(w), *parts]
    out = frames.withColumn("y", F.concat(*parts)).filter("y is not null")
    return out.select("rec_id", "frame_idx", F.col("y").alias("x"))


def trajectories(frames: DataFrame, context: int) -> DataFrame:
    """For each band its values in ``context`` following frames: band after band; incomplete rows are dropped."""
    w = frame_order().rowsBetween(0, context - 1)
    held = frames.withColumn("near", F.collect_list("x").over(w)).filter(F.size("near") == context)
    bands = F.transform("x", lambda v, i: F.transform("near", lambda f: F.element_at(f, (i + 1).cast("int"))))
    return held.select("rec_id", "frame_idx", F.flatten(bands).alias("x"))


def smooth_voicing(frames: DataFrame, flag: str = "voiced") -> DataFrame:
    """Voiced runs shorter than 3 become unvoiced, unvoiced gaps of one frame become voiced; edges are replicated."""
    w = frame_order()
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def at(j: int) -> Column:
        if j == 0:
            return F.col(flag)
        return F.coalesce(F.lead(flag, j).over(w), F.last(flag).over(whole)) if j > 0 else F.coalesce(F.lag(flag, -j).over(w), F.first(flag).over(whole))

    in_run = ((at(-2) == 1) & (at(-1) == 1)) | ((at(-1) == 1) & (at(1) == 1)) | ((at(1) == 1) & (at(2) == 1))
    new = F.when((F.col(flag) == 1) & ~in_run, 0).when((F.col(flag) == 0) & (at(-1) == 1) & (at(1) == 1), 1).otherwise(F.col(flag))
    return frames.withColumn(flag, new)


def above_mean(samples: DataFrame, *order: str, key: str = "rec_id") -> DataFrame:
    """Samples with speech: 1 above the mean of their record, else 0.

    The mean is added up in the order of the samples (``order``, or idx), wherever rows lie: a sample may equal it, and the last bit decides.
    """
    whole = W.partitionBy(key).orderBy(*(order or ("idx",))).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return samples.withColumn("speech", (F.col("value") > F.avg("value").over(whole)).cast("int"))


def close_then_open(samples: DataFrame, radius: int, mask: str = "speech") -> DataFrame:
    """Morphological closing, then opening of a 0/1 mask."""
    w = sample_order().rowsBetween(-radius, radius)
    for step in (F.max, F.min, F.min, F.max):
        samples = samples.withColumn(mask, step(mask).over(w))
    return samples


def running_energy(samples: DataFrame, length: int) -> DataFrame:
    """Energy of tumbling windows about the mean of all samples so far: rec_id, win, energy, peak."""
    so_far = samples.withColumn("mean", F.avg("value").over(sample_order().rowsBetween(W.unboundedPreceding, 0)))
    win = F.floor(F.col("idx") / length).alias("win")
    return so_far.groupBy("rec_id", win).agg(F.sum(F.abs(F.col("value") - F.col("mean"))).alias("energy"), F.max(F.abs("value")).alias("peak"))


def silence_ends(samples: DataFrame, mask: str = "speech") -> DataFrame:
    """Lengths of the initial and the terminal silence of each record."""
    spoken = F.col(mask) == 1
    return samples.groupBy("rec_id").agg(
        F.coalesce(F.min(F.when(spoken, F.col("idx"))), F.count("*")).alias("initial"), (F.count("*") - 1 - F.coalesce(F.max(F.when(spoken, F.col("idx"))), F.lit(-1))).alias("terminal")
    )


def local_maxima(x: Column) -> Column:
    """Zero-based places that are not below either neighbour."""
    inner = F.when(F.size(x) > 2, F.sequence(F.lit(2), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(inner, lambda i: (F.element_at(x, i - 1) <= F.element_at(x, i)) & (F.element_at(x, i) >= F.element_at(x, i + 1))), lambda i: i - 1)


def segment_end(seconds: float) -> int:
    """Index of the last frame that ends before ``seconds``: frames end at 0.032 s and every 0.016 s after."""
    return math.ceil((seconds - 0.032) / 0.016 - 1e-9) - 1
