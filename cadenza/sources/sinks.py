"""Distributed writers: each record's rows are sorted in the task that writes its file, and never gathered.

A file is written under a name of its own and renamed when it is whole, so a repeated attempt replaces it by the same bytes.
Folders are URIs that pyarrow opens.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.scalars import round_half_up
from cadenza.sources import formats


def _write(rows: DataFrame, folder: str, suffix: str, head: Callable[[np.ndarray, int], bytes], body: Callable[[np.ndarray], bytes]) -> DataFrame:
    """path, rows of the files. ``rows``: rec_id string, n (rows of the record), x, sorted within its partitions."""

    def run(batches):
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        record, out, name, held, done = None, None, "", 0, []

        def close():
            out.close()
            store.move(name, f"{top}/{record}{suffix}")
            done.append((f"{record}{suffix}", held))

        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            wide = isinstance(batch.column(2), pa.ListArray)
            values = np.asarray(batch.column(2).flatten() if wide else batch.column(2), np.float64)
            values = values.reshape(len(ids), -1) if wide else values
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                if ids[a] != record or out is None:
                    if out is not None:
                        close()
                    record, name, held = ids[a], f"{top}/.{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(name, compression=None)
                    out.write(head(values[a:b], sizes[a]))
                out.write(body(values[a:b]))
                held += b - a
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "rows"])

    return rows.mapInArrow(run, "file string, rows long").select(F.concat(F.lit(folder.rstrip("/") + "/"), "file").alias("path"), "rows")


def _sorted(table: DataFrame, order: str, value: str) -> DataFrame:
    sizes = table.groupBy("rec_id").agg(F.count("*").alias("n"))
    rows = table.join(sizes, "rec_id").select(F.col("rec_id").cast("string").alias("rec_id"), order, "n", value)
    return rows.repartition("rec_id").sortWithinPartitions("rec_id", order).select("rec_id", "n", value)


def write_frame_files(frames: DataFrame, folder: str, *, double: bool = False, header: bool = True) -> DataFrame:
    """A binary frame file for each record: its width and rows of single (or double) precision."""
    kind = "<f8" if double else "<f4"
    return _write(_sorted(frames, "frame_idx", "x"), folder, ".ft", lambda x, n: struct.pack("<i", x.shape[1]) if header else b"", lambda x: x.astype(kind).tobytes())


def write_wav_files(samples: DataFrame, folder: str, rate: int = 8000) -> DataFrame:
    """A 16-bit mono file for each record of samples (idx, value) within [-1, 1]; others are clipped."""
    pcm = lambda v: np.clip(np.floor(v * 32767 + 0.5), -32768, 32767).astype("<i2").tobytes()
    return _write(_sorted(samples, "idx", "value"), folder, ".wav", lambda v, n: formats.wav_header(n, rate), pcm)


def write_sample_files(samples: DataFrame, folder: str) -> DataFrame:
    """A binary sample file for each record: width, then class, result and single precision row of each sample (idx, c, y, x)."""

    def body(x: np.ndarray) -> bytes:
        return formats.encode_samples(x[:, 0].astype(np.int16), x[:, 1].astype(np.int16), x[:, 2:])[4:]

    packed = samples.withColumn("x", F.concat(F.array(F.col("c").cast("double"), F.col("y").cast("double")), "x"))
    return _write(_sorted(packed, "idx", "x"), folder, ".samples", lambda x, n: struct.pack("<i", x.shape[1] - 2), body)


def append_lines(lines: DataFrame, folder: str) -> None:
    """Adds rows (value) to a folder of text files."""
    lines.select("value").write.mode("append").text(folder)


def test_log_lines(tests: DataFrame) -> DataFrame:
    """value: the tab-separated, labelled fields of test rows (file, date, start, end, n, percentage, latitude, longitude)."""
    labels = [("", "file"), ("Date:", "date"), ("start:", "start"), ("end:", "end"), ("speaker count:", "n"), ("speach percentage:", "percentage"), ("latitude:", "latitude"), ("longitude:", "longitude")]
    parts = [F.col(c).cast("string") if not label else F.concat(F.lit(label + "\t"), F.col(c).cast("string")) for label, c in labels]
    return tests.select(F.concat_ws("\t", *parts).alias("value"))


def append_tests(tests: DataFrame, folder: str) -> DataFrame:
    """Adds rows to the table of tests and returns the whole table."""
    tests.write.mode("append").parquet(folder)
    return tests.sparkSession.read.parquet(folder)


def write_features(features: DataFrame, pitches: DataFrame, folder: str) -> None:
    """The pair of a recording's files: coefficients and pitch, a line a frame."""
    formats.write_text_frames(features, f"{folder.rstrip('/')}/mfcc")
    line = F.col("pitch").cast("string").alias("value")
    pitches.repartition("rec_id").sortWithinPartitions("rec_id", "frame_idx").select(line).write.text(f"{folder.rstrip('/')}/pitch")


# Bits, rate, header bytes and law of the named raw formats; integers are signed and little-endian.
AUDIO_FORMATS = {
    "ssg/16": (16, 16000, 0, None),
    "ssg/8": (16, 8000, 0, None),
    "ulaw/16": (8, 16000, 0, "ulaw"),
    "ulaw/8": (8, 8000, 0, "ulaw"),
    "alaw/16": (8, 16000, 0, "alaw"),
    "alaw/8": (8, 8000, 0, "alaw"),
    "sphere/8": (8, 8000, 1024, "ulaw"),
    "wav/44": (16, 44100, 44, None),
    "wav/32": (16, 32000, 44, None),
    "wav/16": (16, 16000, 44, None),
    "wav/8": (16, 8000, 44, None),
}


def audio_format(name: str) -> dict:
    """The options of :func:`cadenza.sources.formats.decode_pcm`, and the rate, of a named format."""
    if name not in AUDIO_FORMATS:
        raise ValueError(f"unknown audio format {name}; known are {json.dumps(list(AUDIO_FORMATS))}")
    bits, rate, header, law = AUDIO_FORMATS[name]
    return {"bits": bits, "rate": rate, "header": header, "law": law}


def read_as(spark: SparkSession, path: str, form: str, dim: int | None = None) -> DataFrame:
    """rec_id, frame_idx, x of files in one of the frame formats: float, double, ascii."""
    if form in ("float", "double"):
        return formats.read_frames(spark, path, double=form == "double", dim=dim)
    if form == "ascii":
        return _numbered_text(spark, path, dim)
    raise ValueError(f"unknown format {form}")


def _numbered_text(spark: SparkSession, path: str, dim: int | None) -> DataFrame:
    """rec_id, frame_idx, x of text frames: a record is a ``rec_id=`` folder, or where there are none a file.

    Lines are numbered by file, split and order within the split, so frames keep their order whatever the number of tasks.
    """
    text = spark.read.text(path)
    record = F.col("rec_id").cast("string") if "rec_id" in text.columns else F.col("_metadata.file_path")
    lines = text.select(record.alias("rec_id"), F.split(F.trim("value"), r"\s+").alias("parts"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    lines = lines.filter(F.col("parts")[0] != "")
    x = F.transform("parts", lambda v: v.cast("double"))
    if dim is not None:
        x = F.when(F.size("parts") == dim, x).otherwise(F.raise_error(F.lit(f"a frame that is not {dim} wide")))
    order = W.partitionBy("rec_id").orderBy("file", "at", "line")
    return lines.select("rec_id", (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), x.alias("x"))


def write_as(frames: DataFrame, folder: str, form: str) -> None:
    """Frames in one of the formats that :func:`read_as` reads; text has three decimals."""
    if form in ("float", "double"):
        write_frame_files(frames, folder, double=form == "double").count()
    elif form == "ascii":
        rounded = frames.withColumn("line", F.concat_ws(" ", F.transform("x", lambda v: round_half_up(v).cast("string"))))
        rounded = rounded.repartition("rec_id").sortWithinPartitions("rec_id", "frame_idx")
        rounded.select("rec_id", F.col("line").alias("value")).write.mode("append").partitionBy("rec_id").text(folder)
    else:
        raise ValueError(f"unknown format {form}")


def convert(spark: SparkSession, source: str, source_form: str, target: str, target_form: str, dim: int | None = None) -> None:
    """Files of one frame format as files of another."""
    write_as(read_as(spark, source, source_form, dim), target, target_form)
