"""Generated signals: (idx, value) tables of any length, made where they are used."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sine(spark: SparkSession, rate: int, samples: int, frequencies: list[float], amplitude: float = 0.3) -> DataFrame:
    """``amplitude`` times the sum of sines."""
    terms = [F.sin(2 * math.pi * f * F.col("id") / float(rate)) for f in frequencies]
    return spark.range(samples).select(F.col("id").alias("idx"), (amplitude * sum(terms[1:], terms[0])).alias("value"))


def constant(spark: SparkSession, samples: int, value: float = 0.3) -> DataFrame:
    return spark.range(samples).select(F.col("id").alias("idx"), F.lit(float(value)).alias("value"))
