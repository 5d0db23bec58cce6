"""Scalar functions: scales, labels, rounding, statistics, gender and clock formats."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label alphabet, in its order.
ALPHABET = string.digits + string.ascii_uppercase + string.ascii_lowercase
CLOCKS = {"date": "yyyy/MM/dd", "time": "HH:mm", "stamp": "yyyy.MM.dd.HH.mm.ss.SSS", "day": "dd", "hour": "HH", "minute": "mm", "full": "yyyy/MM/dd HH:mm:ss"}


def hertz_to_mel(f: Column) -> Column:
    return 1127.0 * F.log1p(f / 700.0)


def mel_to_hertz(m: Column) -> Column:
    return 700.0 * F.expm1(m / 1127.0)


def energy_to_db(e: Column, base: float = 0.0) -> Column:
    return 10.0 * F.log10(e + base)


def round_half_up(x: Column, decimals: int = 3) -> Column:
    """``floor(x * 10**d + 0.5) / 10**d``: halves go up for either sign."""
    return F.floor(x * 10.0**decimals + 0.5) / 10.0**decimals


def label_to_id(label: Column) -> Column:
    """Place of a one-character label in :data:`ALPHABET`, -1 if it isn't there."""
    return F.when(F.length(label) == 1, F.instr(F.lit(ALPHABET), label) - 1).otherwise(-1)


def id_to_label(i: Column) -> Column:
    return F.substring(F.lit(ALPHABET), i + 1, F.lit(1))


def gender(pitch: Column, male_upper: float, female_lower: float) -> Column:
    """1 below the male bound, 2 above the female bound, 0 else."""
    return F.when(pitch < male_upper, 1).when(pitch > female_lower, 2).otherwise(0)


def gender_decision(a: Column, b: Column) -> Column:
    """-1 if either is uncertain, 1 if both agree, 0 if they differ."""
    return F.when((a == 0) | (b == 0), -1).when(a == b, 1).otherwise(0)


def in_range(pitch: Column, low: float, high: float) -> Column:
    """The pitch, or -1 outside the bounds."""
    return F.when(~F.isnan(pitch) & pitch.between(low, high), pitch).otherwise(-1.0)


def battery(level: Column, scale: Column) -> Column:
    return F.when((level == -1) | (scale == -1) | level.isNull() | scale.isNull(), 50.0).otherwise(level / scale * 100.0)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, by the series of the public 26.2.17 approximation of Abramowitz and Stegun (error below 7.5e-8)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


# Coefficients of the rational approximation of the normal quantile, tails and center, and where they meet.
TAIL = 0.0465
TAIL_LINEAR, TAIL_ABOVE, TAIL_BELOW = -1.000182518760158122, (16.682320830719986527, 4.120411523939115059, 0.029814187308200211), (7.173787663925508066, 8.759693508958633869)
CENTER_LINEAR, CENTER_ABOVE, CENTER_BELOW = 1.246899760652504, (0.195740115269792, -0.652871358365296), (0.155331081623468, -0.839293158122257)


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile by a rational approximation (relative error about 1e-5); probabilities are kept off 0 and 1."""
    p = F.least(F.greatest(p.cast("double"), F.lit(1e-32)), F.lit(1 - 1e-32))
    far = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    tail = TAIL_LINEAR * far + TAIL_ABOVE[2] + (TAIL_ABOVE[1] * far + TAIL_ABOVE[0]) / (far * far + TAIL_BELOW[1] * far + TAIL_BELOW[0])
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    center = q * (CENTER_LINEAR + (CENTER_ABOVE[1] * r + CENTER_ABOVE[0]) / (r * r + CENTER_BELOW[1] * r + CENTER_BELOW[0]))
    return F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(center)


def selection_indices(spec: Column) -> Column:
    """array<int>: the indices of a specification such as "0,3-8,1", in its order; a part that is no index or range raises."""

    def one(part: Column) -> Column:
        low, high = (F.regexp_extract(part, r"^(\d+)(?:-(\d+))?$", i) for i in (1, 2))
        top = F.when(high == "", low).otherwise(high).cast("int")
        wrong = F.raise_error(F.concat(F.lit("not an index or range: "), part)).cast("array<int>")
        return F.when(low == "", wrong).when(top >= low.cast("int"), F.sequence(low.cast("int"), top)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.split(F.regexp_replace(spec, r"\s", ""), ","), one))


def file_on_time(ts: Column, extension: str) -> Column:
    """A file's name after the time to the millisecond."""
    return F.concat(F.date_format(ts, CLOCKS["stamp"]), F.lit(f".{extension}"))


def saturated(peak: Column, full: float = 1.0) -> Column:
    """Whether a window's largest amplitude is beyond 0.999 of the full scale."""
    return peak > 0.999 * full


def vtln_warp(f: Column, low: float, high: float, factor: float, top: float) -> Column:
    """Piecewise linear warping of frequencies: slope ``factor`` up to ``low``, joined to the identity at ``high``..``top``."""
    if not 0 < low < high <= top or factor <= 0:
        raise ValueError("0 < low < high <= top and factor > 0 are needed")
    slope = (high - low * factor) / (high - low)
    return F.when(f <= low, f * factor).when(f < high, low * factor + (f - low) * slope).otherwise(f)


def clock(ts: Column, form: str) -> Column:
    return F.date_format(ts, CLOCKS[form])
