"""Binary files of rows of one size, read by byte ranges: a large file is many tasks, and no file is ever one row of Spark.

Spark lists the files without reading them; a small job reads each file's head, which gives the size and number of its rows; ranges of
whole rows are dealt to tasks, which read them in batches. Paths are URIs that pyarrow opens.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a task's range, and of what is decoded at once.
RANGE_BYTES, STEP_BYTES = 64 << 20, 4 << 20
#: (head of a file, its size) -> (width, first row's byte, bytes of a row, rows); raises ValueError for what is no such file.
Layout = Callable[[bytes, int], tuple[int, int, int, int]]
_HEAD = 64


def listed(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """path of each file; contents are not read."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path")


def _opened(path: str):
    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return store.open_input_file(name)


def measured(files: DataFrame, layout: Layout) -> DataFrame:
    """``files`` (path and others) with width, at, step, n, and error for those that can't be read or aren't of the layout."""

    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                try:
                    with _opened(path) as f:
                        out.append((*layout(f.read(_HEAD), f.size()), None))
                except (OSError, ValueError) as error:
                    out.append((None, None, None, None, str(error)))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            found = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "width", "at", "step", "n", "error"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition("path").mapInArrow(run, f"{fields}, width int, at long, step int, n long, error string")


def whole(files: DataFrame) -> DataFrame:
    """Measured files, of which none may have an error."""
    return files.withColumn("n", F.when(F.col("error").isNull(), F.col("n")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("error"))).cast("long")))


def read_ranges(files: DataFrame, decode: Callable[[bytes, int], list[pa.Array]], columns: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, row and ``columns`` of all rows of measured files; ``decode`` makes arrays of (bytes of whole rows, width)."""
    per = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / F.col("step"))).cast("long")
    parts = files.filter("n > 0").select("path", "width", "at", "step", "n", per.alias("per"))
    parts = parts.select("path", "width", "at", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("per"))).alias("first"), "per", "n")
    parts = parts.select("path", "width", "at", "step", "first", F.least("per", F.col("n") - F.col("first")).alias("count"))
    # A number of its own: adaptive execution would put these few bytes, and the reading, into one task.
    parts = parts.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "first")
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                most = max(1, STEP_BYTES // r["step"])
                with _opened(r["path"]) as f:
                    f.seek(r["at"] + r["first"] * r["step"])
                    for first in range(r["first"], r["first"] + r["count"], most):
                        n = min(most, r["first"] + r["count"] - first)
                        raw = f.read(n * r["step"])
                        if len(raw) < n * r["step"]:
                            raise OSError(f"{r['path']} has become shorter")
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n), pa.array(np.arange(first, first + n)), *decode(raw, r["width"])], ["path", "row", *names])

    return parts.mapInArrow(run, f"path string, row long, {columns}")


def concatenated(files: DataFrame, layout: Layout, decode: Callable[[bytes, int], list[pa.Array]], buffer: int) -> tuple[DataFrame, DataFrame]:
    """(idx, value of the files of a list (pos, path) one after the other; pos, path, error of the skipped ones).

    Each file is filled with zeros up to whole buffers, as a reader that fills ``buffer`` samples at a time leaves it. Where a file
    begins is the sum of the filled sizes before it: a row a file, whatever their lengths.
    """
    from cadenza.functions.shared import rewritten

    found = rewritten(measured(files.select("pos", "path"), layout), "listed")
    filled = (F.ceil(F.col("n") / buffer) * buffer).cast("long")
    before = W.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    placed = found.filter("error is null").select("*", filled.alias("filled")).select("*", F.coalesce(F.sum("filled").over(before), F.lit(0)).alias("begin"))
    samples = read_ranges(placed.dropDuplicates(["path"]), decode, "value double")
    body = samples.join(placed.select("path", "begin"), "path").select((F.col("begin") + F.col("row")).alias("idx"), "value")
    tail = placed.filter("filled > n").select(F.explode(F.sequence(F.col("begin") + F.col("n"), F.col("begin") + F.col("filled") - 1)).alias("idx"), F.lit(0.0).alias("value"))
    return body.unionByName(tail), found.filter("error is not null").select("pos", "path", "error")
