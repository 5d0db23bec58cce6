"""File formats of frames, samples, labels, audio and models: readers and writers over Spark's file sources.

Frame, sample and audio files are read by byte ranges (:mod:`cadenza.sources.ranges`), text formats are split by Spark; files of byte
labels and labelled frames are read whole. Everything is little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources import ranges

#: Bytes of decoded frames in one batch handed back to Spark.
BATCH_BYTES = 8 << 20
LABEL_BYTES = 12


class FormatError(ValueError):
    """Bytes that are not of the format."""


def _files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")


def _vectors(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.astype(np.float64).ravel()))


def decode_frames(raw: bytes, double: bool = False, dim: int | None = None) -> np.ndarray:
    """[frame, component] of a frame file: a 32-bit width and rows of floats; ``dim`` is given for headerless files."""
    at = 0
    if dim is None:
        if len(raw) < 4:
            raise FormatError("a frame file without its width")
        dim, at = struct.unpack_from("<i", raw)[0], 4
    kind = np.dtype("<f8" if double else "<f4")
    if dim <= 0 or (len(raw) - at) % (dim * kind.itemsize):
        raise FormatError("the rows of a frame file are not whole")
    return np.frombuffer(raw, kind, offset=at).reshape(-1, dim)


def encode_frames(rows: np.ndarray, double: bool = False, header: bool = True) -> bytes:
    """A frame file; single precision unless ``double``."""
    rows = np.asarray(rows, np.float64)
    return (struct.pack("<i", rows.shape[1]) if header else b"") + rows.astype("<f8" if double else "<f4").tobytes()


def _frame_layout(double: bool, dim: int | None) -> ranges.Layout:
    size = 8 if double else 4

    def layout(head: bytes, length: int) -> tuple[int, int, int, int]:
        width, at = dim, 0
        if width is None:
            if len(head) < 4:
                raise FormatError("a frame file without its width")
            width, at = struct.unpack_from("<i", head)[0], 4
        if width <= 0 or (length - at) % (width * size):
            raise FormatError("the rows of a frame file are not whole")
        return width, at, width * size, (length - at) // (width * size)

    return layout


def read_frames(spark: SparkSession, path: str | list[str], *, double: bool = False, dim: int | None = None, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """rec_id (the file), frame_idx, x of binary frame files, by byte ranges."""
    kind = "<f8" if double else "<f4"
    files = ranges.whole(ranges.measured(ranges.listed(spark, path), _frame_layout(double, dim)))
    rows = ranges.read_ranges(files, lambda raw, width: [_vectors(np.frombuffer(raw, kind).reshape(-1, width))], "x array<double>", range_bytes)
    return rows.select(F.col("path").alias("rec_id"), F.col("row").alias("frame_idx"), "x")


def read_labelled_frames(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """rec_id, frame_idx, label, x of files of 12-byte labels and single precision rows."""

    def run(batches):
        kind = np.dtype([("label", f"S{LABEL_BYTES}"), ("x", "<f4", (dim,))])
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = np.frombuffer(raw, kind)
                labels = [x.decode("ascii").strip("\0 ") for x in rows["label"].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(np.arange(len(rows))), pa.array(labels, pa.string()), _vectors(rows["x"])], ["rec_id", "frame_idx", "label", "x"])

    return _files(spark, path).mapInArrow(run, "rec_id string, frame_idx long, label string, x array<double>")


def read_samples(spark: SparkSession, path: str, *, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """rec_id, idx, c, y, x of binary sample files: a 32-bit width, then class, result and single precision row; by byte ranges."""

    def layout(head: bytes, length: int) -> tuple[int, int, int, int]:
        if len(head) < 4:
            raise FormatError("a sample file without its width")
        (width,) = struct.unpack_from("<i", head)
        if width <= 0 or (length - 4) % (4 + 4 * width):
            raise FormatError("the rows of a sample file are not whole")
        return width, 4, 4 + 4 * width, (length - 4) // (4 + 4 * width)

    def decode(raw: bytes, width: int) -> list[pa.Array]:
        rows = np.frombuffer(raw, np.dtype([("c", "<i2"), ("y", "<i2"), ("x", "<f4", (width,))]))
        return [pa.array(rows["c"].astype(np.int16)), pa.array(rows["y"].astype(np.int16)), _vectors(rows["x"])]

    rows = ranges.read_ranges(ranges.whole(ranges.measured(ranges.listed(spark, path), layout)), decode, "c smallint, y smallint, x array<double>", range_bytes)
    return rows.select(F.col("path").alias("rec_id"), F.col("row").alias("idx"), "c", "y", "x")


def encode_samples(c: np.ndarray, y: np.ndarray, x: np.ndarray) -> bytes:
    rows = np.zeros(len(c), np.dtype([("c", "<i2"), ("y", "<i2"), ("x", "<f4", (x.shape[1],))]))
    rows["c"], rows["y"], rows["x"] = c, y, x
    return struct.pack("<i", x.shape[1]) + rows.tobytes()


def read_text_frames(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """rec_id, x of text files with a frame a line; lines of another width than ``dim`` raise."""
    rows = spark.read.text(path).select(F.input_file_name().alias("rec_id"), F.split(F.trim("value"), r"\s+").alias("parts")).filter(F.col("parts")[0] != "")
    x = F.transform("parts", lambda v: v.cast("double"))
    if dim is not None:
        x = F.when(F.size("parts") == dim, x).otherwise(F.raise_error(F.lit(f"a frame that is not {dim} wide")))
    return rows.select("rec_id", x.alias("x"))


def read_text_samples(spark: SparkSession, path: str) -> DataFrame:
    """c, y, x of lines ``c y x0 x1 ...``."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") > 2)
    return rows.select(F.col("p")[0].cast("smallint").alias("c"), F.col("p")[1].cast("smallint").alias("y"), F.transform(F.slice("p", F.lit(3), F.size("p") - 2), lambda v: v.cast("double")).alias("x"))


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """path, words of lines ``file word word ...``; empty lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(parts.alias("p")).filter(F.col("p")[0] != "").select(F.col("p")[0].alias("path"), F.slice("p", F.lit(2), F.size("p") - 1).alias("words"))


def read_pairs(spark: SparkSession, path: str, out_dir: str | None = None) -> DataFrame:
    """src, dst of two-column list lines, or of names and a folder; malformed lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p"))
    if out_dir is None:
        return rows.filter(F.size("p") == 2).select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))
    return rows.filter((F.size("p") == 1) & (F.col("p")[0] != "")).select(F.col("p")[0].alias("src"), F.concat_ws("/", F.lit(out_dir), F.regexp_extract(F.col("p")[0], "[^/]*$", 0)).alias("dst"))


def read_byte_labels(spark: SparkSession, path: str) -> DataFrame:
    """rec_id, frame_idx, label of files with one byte per frame."""
    rows = _files(spark, path).select(F.col("path").alias("rec_id"), F.decode("content", "ISO-8859-1").alias("s"))
    return rows.filter(F.length("s") > 0).select("rec_id", F.posexplode(F.split("s", "")).alias("i", "label")).filter("label <> ''").select("rec_id", F.col("i").cast("long").alias("frame_idx"), "label")


def write_text_frames(frames: DataFrame, path: str) -> None:
    """A line a frame, three decimals, halves rounded up; order within a file is that of rec_id and frame_idx."""
    from cadenza.functions.scalars import round_half_up

    line = F.concat_ws(" ", F.transform("x", lambda v: round_half_up(v).cast("string")))
    frames.repartition("rec_id").sortWithinPartitions("rec_id", "frame_idx").select(line.alias("value")).write.text(path)


def g711_table(law: str) -> list[float]:
    """The 256 expanded values of A-law or mu-law bytes, in [-1, 1], from the segments of G.711."""
    out = []
    for byte in range(256):
        if law == "alaw":
            v = byte ^ 0x55
            exponent, mantissa = (v >> 4) & 7, v & 15
            size = (mantissa << 4) + 8 if exponent == 0 else ((mantissa << 4) + 0x108) << (exponent - 1)
            out.append((size if v & 0x80 else -size) / 32767.0)
        elif law == "ulaw":
            v = ~byte & 0xFF
            size = ((((v & 15) << 3) + 0x84) << ((v >> 4) & 7)) - 0x84
            out.append((-size if v & 0x80 else size) / 32767.0)
        else:
            raise ValueError(f"unknown law {law}")
    return out


def decode_pcm(raw: bytes, bits: int = 16, signed: bool = True, big_endian: bool = False, header: int = 0, law: str | None = None) -> np.ndarray:
    """Samples in [-1, 1]: integers over ``2**(bits - 1) - 1``, clipped; a broken last sample is dropped."""
    body = raw[header:]
    if law:
        return np.array(g711_table(law))[np.frombuffer(body, np.uint8)]
    if bits not in (8, 16, 32):
        raise ValueError("8, 16 or 32 bits")
    kind = np.dtype(f"{'>' if big_endian else '<'}{'i' if signed else 'u'}{bits // 8}")
    values = np.frombuffer(body[: len(body) // kind.itemsize * kind.itemsize], kind).astype(np.float64)
    values = values if signed else values - 2 ** (bits - 1)
    return np.clip(np.nan_to_num(values / (2 ** (bits - 1) - 1)), -1.0, 1.0)


def wav_header(samples: int, rate: int = 8000) -> bytes:
    """The 44 bytes before 16-bit mono samples."""
    size = samples * 2
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", size)


def encode_wav(values: np.ndarray, rate: int = 8000) -> bytes:
    return wav_header(len(values), rate) + np.clip(np.round(np.asarray(values) * 32767), -32768, 32767).astype("<i2").tobytes()


def _audio_layout(wav: bool, bits: int, law: str | None) -> ranges.Layout:
    step, at = 1 if law else bits // 8, 44 if wav else 0

    def layout(head: bytes, length: int) -> tuple[int, int, int, int]:
        if wav and (head[:4] != b"RIFF" or head[8:12] != b"WAVE"):
            raise FormatError("not a WAV file")
        return 1, at, step, max(0, length - at) // step

    return layout


def read_audio(spark: SparkSession, path: str | list[str], *, wav: bool = True, chunk: int = 8000, bits: int = 16, law: str | None = None, **form) -> DataFrame:
    """rec_id, chunk_idx, samples (array): ``chunk`` samples a row, by byte ranges; the 44 bytes before those of ``wav`` files are skipped."""
    inner, step = _audio_layout(wav, bits, law), 1 if law else bits // 8

    def layout(head: bytes, length: int) -> tuple[int, int, int, int]:  # a row is a chunk; the last may be short
        _, at, _, n = inner(head, length)
        return 1, at, chunk * step, n // chunk

    def decode(raw: bytes, _: int) -> list[pa.Array]:
        return [_vectors(decode_pcm(raw, bits=bits, law=law, **form).reshape(-1, chunk))]

    files = ranges.whole(ranges.measured(ranges.listed(spark, path), layout))
    full = ranges.read_ranges(files, decode, "samples array<double>").select(F.col("path").alias("rec_id"), F.col("row").alias("chunk_idx"), "samples")
    rest = ranges.whole(ranges.measured(ranges.listed(spark, path), lambda head, length: (1, inner(head, length)[1] + inner(head, length)[3] // chunk * chunk * step, step, inner(head, length)[3] % chunk)))
    each = ranges.read_ranges(rest, lambda raw, _: [pa.array(decode_pcm(raw, bits=bits, law=law, **form))], "value double")
    short = each.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("s"))  # fewer than a chunk
    short = short.join(rest.select("path", "at", "step"), "path").select(F.col("path").alias("rec_id"), F.floor((F.col("at") - (44 if wav else 0)) / (chunk * F.col("step"))).alias("chunk_idx"), F.col("s.value").alias("samples"))
    return full.unionByName(short)


def concatenated_audio(files: DataFrame, *, buffer: int, wav: bool = True, bits: int = 16, law: str | None = None, **form) -> tuple[DataFrame, DataFrame]:
    """(idx, value; the skipped files) of audio files listed as (pos, path): see :func:`cadenza.sources.ranges.concatenated`."""
    return ranges.concatenated(files, _audio_layout(wav, bits, law), lambda raw, _: [pa.array(decode_pcm(raw, bits=bits, law=law, **form))], buffer)


def sample_rows(audio: DataFrame, chunk: int = 8000) -> DataFrame:
    """rec_id, idx, value of chunked audio."""
    return audio.select("rec_id", "chunk_idx", F.posexplode("samples").alias("i", "value")).select("rec_id", (F.col("chunk_idx") * chunk + F.col("i")).alias("idx"), "value")


def float_pcm(raw: Column) -> Column:
    """array<float>: 16-bit samples times 3.051851e-05 in single precision."""

    @F.pandas_udf("array<float>")
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 2 * 2], "<i2").astype(np.float32) * np.float32(3.051851e-05))

    return run(raw)


def mixture_bytes(weights: np.ndarray, means: np.ndarray, variances: np.ndarray, model_id: int = 0) -> bytes:
    """A diagonal mixture file: id, width, size, 0, then id, prior, mean and variance of each component."""
    out = struct.pack("<iiii", model_id, means.shape[1], len(means), 0)
    for i, (w, m, v) in enumerate(zip(weights, means, variances, strict=True)):
        out += struct.pack("<id", i, w) + m.astype("<f8").tobytes() + v.astype("<f8").tobytes()
    return out


def mixture_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, variances) of a diagonal mixture file."""
    _, dim, size, full = struct.unpack_from("<iiii", raw)
    if full:
        raise FormatError("a mixture of full covariances")
    rows = np.frombuffer(raw, np.dtype([("id", "<i4"), ("w", "<f8"), ("m", "<f8", (dim,)), ("v", "<f8", (dim,))]), size, 16)
    return rows["w"].copy(), rows["m"].copy(), rows["v"].copy()


def mvn_bytes(n: int, means: np.ndarray, variances: np.ndarray) -> bytes:
    """Normalisation statistics: count, width, means, variances, deviations."""
    return struct.pack("<qi", n, len(means)) + b"".join(np.asarray(x, "<f8").tobytes() for x in (means, variances, np.sqrt(variances)))


def mvn_of(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    n, dim = struct.unpack_from("<qi", raw)
    values = np.frombuffer(raw, "<f8", 3 * dim, 12).reshape(3, dim)
    return n, values[0].copy(), values[1].copy(), values[2].copy()


def projection_bytes(mean: np.ndarray, rows: np.ndarray, values: np.ndarray) -> bytes:
    """A projection: rows, width, mean, rows and eigenvalues."""
    return struct.pack("<ii", *rows.shape) + b"".join(np.asarray(x, "<f8").tobytes() for x in (mean, rows, values))


def projection_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, rows, eigenvalues) of a projection file."""
    n, dim = struct.unpack_from("<ii", raw)
    if len(raw) != 8 + 8 * (dim + n * dim + n):
        raise FormatError("a projection of another size than its header says")
    flat = np.frombuffer(raw, "<f8", offset=8)
    return flat[:dim].copy(), flat[dim : dim + n * dim].reshape(n, dim).copy(), flat[dim + n * dim :].copy()


def chain_bytes(initial: np.ndarray, transitions: np.ndarray, emissions: np.ndarray, model_id: int = 0) -> bytes:
    """A chain with discrete emissions: id, states, initial and transition probabilities in single precision, then each state's."""
    out = struct.pack("<ih", model_id, len(initial)) + initial.astype("<f4").tobytes() + transitions.astype("<f4").tobytes()
    return out + b"".join(struct.pack("<i", len(e)) + e.astype("<f8").tobytes() for e in emissions)


def chain_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(initial, transitions, emissions) of a chain file."""
    _, n = struct.unpack_from("<ih", raw)
    flat = np.frombuffer(raw, "<f4", n + n * n, 6).astype(np.float64)
    at, emissions = 6 + 4 * (n + n * n), []
    for _ in range(n):
        (m,) = struct.unpack_from("<i", raw, at)
        emissions.append(np.frombuffer(raw, "<f8", m, at + 4))
        at += 4 + 8 * m
    if at != len(raw):
        raise FormatError("a chain of another size than its header says")
    return flat[:n], flat[n:].reshape(n, n), np.array(emissions)
