"""Folders that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Unset, a local session (tests) gets a temporary folder; a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="cadenza-"))
        found = _local[0]
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rewritten(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to such a folder and read back: its lineage ends there."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only_row(table: DataFrame, what: str) -> DataFrame:
    """The row of a table that must not have two: evaluated where it is joined, several rows raise; none stays none."""
    columns = [F.first(F.struct(F.col(c))).alias(c) for c in table.columns]
    counted = table.agg(F.count("*").alias("_n"), *columns).filter("_n > 0")
    checked = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{what}: one row is needed")).cast("boolean"))
    return counted.filter(checked).select(*[F.col(f"{c}.{c}").alias(c) for c in table.columns])
