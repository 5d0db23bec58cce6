"""Structured Streaming forms of the capture and sequence operators.

Event time is ``ts`` with a watermark; rows later than that are dropped. Windows emit once, in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def replay(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def peaks(events: DataFrame, width: str = "120 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Peak amplitude of each tumbling window, as the capture's meter shows it between two flushes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.max(F.abs("value")).alias("peak"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "peak", "n")


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Recording sessions of each source: runs without a gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def running_statistics(events: DataFrame) -> DataFrame:
    """Count, mean and population variance so far of each source (update or complete mode)."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))


def framed(events: DataFrame, length: int, shift: int) -> DataFrame:
    """user_id, frame_idx, x: overlapping frames of each source's samples in arrival order.

    State holds the samples that later frames need, at most ``length`` of them, and the number of frames so far.
    """
    if not 0 < shift <= length:
        raise ValueError("0 < shift <= length is needed")
    out = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("frame_idx", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    kept = T.StructType([T.StructField("frames", T.LongType()), T.StructField("rest", T.ArrayType(T.DoubleType()))])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames, rest = state.get if state.exists else (0, [])
        rest = list(rest)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        rest += rows["value"].tolist()
        found = []
        while len(rest) >= length:
            found.append((key[0], frames, rest[:length]))
            rest, frames = rest[shift:], frames + 1
        state.update((frames, rest))
        yield pd.DataFrame(found, columns=["user_id", "frame_idx", "x"])

    return events.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def teed(stream: DataFrame, *sinks, checkpoint: str):
    """Starts a query that hands every micro-batch to all ``sinks`` (functions of frame and batch id)."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
