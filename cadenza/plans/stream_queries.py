"""Stream operators over files of the driver's tables, held against the SQL of the finished tables.

Rows are written as files in the order of their times, every seventh a part later than it should be; a last row of no source moves the
clock on, so that all windows close and all sources end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import streaming
from cadenza.functions.shared import fresh_folder
from cadenza.operators import sequence as S
from cadenza.plans import frame_queries, model_queries, signal_queries  # noqa: F401  their SQL is used below
from cadenza.plans.bindings import SAMPLES, cells, r6
from cadenza.plans.catalog import ORACLES, query, table
from cadenza.streaming import stateful

PARTS, CLOCK = 3, -1


def staged(spark: SparkSession, rows: DataFrame, key: str, seq: str) -> tuple[DataFrame, str, int]:
    """(stream of ``rows`` from files, how late rows are, ms after which a source has ended). A pass over the rows for each part."""
    folder, rows = fresh_folder(spark, "staged"), rows.withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    low, high = (0, 0) if low is None else (low, high)
    span = (high - low) // PARTS + 1
    late, idle = 2 * span + 1_000_000, high - low + 1_000_000
    part = F.floor((F.unix_micros("ts") - low) / span) + F.when(F.pmod(F.xxhash64(key, seq), F.lit(7)) == 0, 1).otherwise(0)
    for i in range(PARTS + 1):
        rows.filter(part == i).write.mode("append").parquet(folder)
    clock = {"ts": F.timestamp_micros(F.lit(high + late + idle + 10_000_000)), key: F.lit(CLOCK), seq: F.lit(CLOCK)}
    spark.range(1).select(*[clock.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]).write.mode("append").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // PARTS + 1).parquet(folder)
    return stream, f"{late} microseconds", idle // 1000 + 1


def _run(spark: SparkSession, rows: DataFrame, operator: Callable[..., DataFrame]) -> DataFrame:
    stream, late, idle = staged(spark, rows, "rec_id", "seq")
    return stateful.run_available(operator(stream, late=late, idle_ms=idle), fresh_folder(spark, "stream"), fresh_folder(spark, "checkpoint"))


_LABELS = f"""WITH {SAMPLES}, m AS (SELECT *, count(*) OVER (PARTITION BY rec_id) AS n, avg(value) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS mean FROM samples),
e AS (SELECT rec_id, idx // 5 AS win, sum(abs(value - mean)) / 5 AS energy FROM m WHERE (idx // 5 + 1) * 5 < n GROUP BY ALL),
s0 AS (SELECT rec_id, win, (energy > exp(avg(ln(energy + 1e-6)) OVER (PARTITION BY rec_id)))::INT AS s FROM e),
""" + ",\n".join(f"s{i + 1} AS (SELECT rec_id, win, {f}(s) OVER (PARTITION BY rec_id ORDER BY win ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM s{i})" for i, f in enumerate(("max", "min", "min", "max")))


@query("str4_incremental_speech", f"{_LABELS} SELECT rec_id, win, s AS speech FROM s4")
def incremental_speech(spark, sf_dir):
    """Labels of windows of five samples while the threshold moves: the last version of each is what the whole history gives."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), "ts", F.col("event_id").alias("seq"), F.array("value").alias("x"))
    return stateful.latest_labels(_run(spark, rows, lambda s, **k: stateful.speech_labels(s, 5, 2, **k)))


def _frames(spark, sf_dir):
    """Frames with times: a second each, in the order of their vectors, after the epoch, at which watermarks start."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").cast("long").alias("rec_id"), F.timestamp_seconds(F.col("vec_id") + 1).alias("ts"), F.col("vec_id").cast("long").alias("seq"), F.col("embedding").cast("array<double>").alias("x"))


def _framed(name: str, like: str, operator: Callable[..., DataFrame]) -> None:
    @query(name, ORACLES[like])
    def run(spark, sf_dir):
        return cells(_run(spark, _frames(spark, sf_dir), operator), "rec_id", "frame_idx")


_framed("str7_stream_delta", "win7_delta_context5", lambda s, **k: stateful.regression_delta(s, 5, **k))
_framed("str7_stream_shifted_delta", "win8_shifted_delta", lambda s, **k: stateful.shifted_delta(s, **k))
_framed("str7_stream_trajectories", "win9_trajectories", lambda s, **k: stateful.trajectories(s, 5, **k))


@query("str7_stream_voicing", ORACLES["win10_voicing_smoothing"])
def stream_voicing(spark, sf_dir):
    events = S.above_mean(table(spark, sf_dir, "events"), "ts", "event_id", key="user_id")
    rows = events.select(F.col("user_id").alias("rec_id"), "ts", F.col("event_id").alias("seq"), F.array(F.col("speech").cast("double")).alias("x"))
    return _run(spark, rows, stateful.smooth_voicing).select("rec_id", F.col("frame_idx").alias("idx"), F.col("x")[0].cast("int").alias("speech"))


def _committed(spark, sf_dir, mode: str, operator: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    stream, late, _ = staged(spark, table(spark, sf_dir, "events"), "user_id", "event_id")
    return stateful.run_committed(operator(stream, late), mode, fresh_folder(spark, "stream"), fresh_folder(spark, "checkpoint"))


@query("str1_stream_peaks", ORACLES["str1_window_peaks"])
def stream_peaks(spark, sf_dir):
    found = _committed(spark, sf_dir, "append", lambda s, late: streaming.peaks(s, "1 hour", late))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("peak", 6).alias("peak"), "n")


# Values of two decimals have means that lie on ties at six places where n is a power of two; at ten they don't.
@query("str8_stream_statistics", "SELECT user_id, count(*) AS n, round(avg(value), 10) AS mean, round(var_pop(value), 4) AS var FROM events GROUP BY user_id")
def stream_statistics(spark, sf_dir):
    found = _committed(spark, sf_dir, "complete", lambda s, late: streaming.running_statistics(s.filter(F.col("user_id") != CLOCK)))
    return found.select("user_id", "n", F.round("mean", 10).alias("mean"), F.round("var", 4).alias("var"))


@query("str9_stream_sessions", ORACLES["str9_recording_sessions"])
def stream_sessions(spark, sf_dir):
    found = _committed(spark, sf_dir, "append", lambda s, late: streaming.sessions(s, late=late))
    return found.select("user_id", "n", r6(F.col("mean")).alias("mean"))
