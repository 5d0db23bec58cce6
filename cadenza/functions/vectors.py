"""Vector arithmetic on array<double> columns with higher-order functions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def sub(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def mul(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * b)


def running_deviation(x: Column) -> Column:
    """Population standard deviation of a short array by the running update in its order; null for none."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))

    def update(s: Column, v: Column) -> Column:
        mean = s["mean"] + (v - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["square"] + (v - mean) * (v - s["mean"])).alias("square"))

    return F.when(F.size(x) > 0, F.aggregate(x, start, update, lambda s: F.sqrt(s["square"] / s["n"])))


def quotient(a: Column, b: Column) -> Column:
    """``a / b``; a zero divisor gives infinity or NaN as floating point does, null stays null."""
    beyond = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, beyond)


def div(x: Column, y: Column) -> Column:
    """Component-wise quotient; a zero divisor gives infinity or NaN as floating point does."""
    return F.zip_with(x, y, quotient)


def scale(x: Column, s: Column | float) -> Column:
    return F.transform(x, lambda a: a * s)


def shift(x: Column, s: Column | float) -> Column:
    return F.transform(x, lambda a: a + s)


def dot(x: Column, y: Column) -> Column:
    return total(mul(x, y))


def norm1(x: Column) -> Column:
    return total(F.transform(x, F.abs))


def norm2(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def norm2_of_sum(x: Column, y: Column, s: float) -> Column:
    """Length of ``x + s * y``."""
    return norm2(F.zip_with(x, y, lambda a, b: a + s * b))


def mean(x: Column) -> Column:
    """NaN for an empty vector."""
    return F.when(F.size(x) > 0, F.try_divide(total(x), F.size(x))).otherwise(float("nan"))


def interpolate(x: Column, y: Column, weight: float) -> Column:
    """``(1 - weight) * x + weight * y``."""
    return F.zip_with(x, y, lambda a, b: (1 - weight) * a + weight * b)


def outer(x: Column, y: Column) -> Column:
    return F.transform(x, lambda a: F.transform(y, lambda b: a * b))


def sum_to_one(x: Column) -> Column:
    return F.transform(x, lambda a: a / total(x))


def pick(x: Column, places: list[int]) -> Column:
    """The components at zero-based ``places``, in that order."""
    return F.array(*[F.element_at(x, p + 1) for p in places])


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def manhattan(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def angle(x: Column, y: Column, clamp: bool = False) -> Column:
    """Degrees between two vectors; a ratio beyond 1 by rounding gives NaN unless ``clamp``."""
    ratio = dot(x, y) / (norm2(x) * norm2(y))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)) if clamp else ratio))


def log_sum_exp(x: Column) -> Column:
    def summed(s: Column) -> Column:
        return s["top"] + F.log(total(F.transform(s["x"], lambda a: F.exp(a - s["top"]))))

    # As the only element of an array, the maximum is found once.
    return F.element_at(F.transform(F.array(F.struct(x.alias("x"), F.array_max(x).alias("top"))), summed), 1)


def linear(rows: list[list[float]], x: Column) -> Column:
    """A matrix, given as literal rows, times a vector."""
    return F.transform(F.lit(rows), lambda r: dot(r, x))
