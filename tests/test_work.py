"""Chunk lists as work: each chunk once, whatever stops in between."""

import os

import pytest
from pyspark.sql import functions as F

from cadenza.sources.work import ChunkWork


def _work(spark, folder, n=40, batches=5):
    return ChunkWork.create(spark.range(n).select(F.col("id").alias("chunk"), (F.col("id") * 3).alias("v")), str(folder), batches)


def test_stopped_and_taken_up(spark, tmp_path):
    calls = []

    def work(chunks):
        calls.append(sorted(r["chunk"] for r in chunks.collect()))
        return chunks.withColumn("v", F.col("v") + 1)

    def breaks(chunks):
        return chunks.withColumn("v", F.when(F.col("chunk") >= 0, F.raise_error(F.lit("stopped")).cast("long")))

    first = _work(spark, tmp_path / "w")
    assert first.run(work, 2) == 2 and len(first.committed()) == 2
    with pytest.raises(Exception, match="stopped"):
        first.run(breaks)
    half = os.path.join(tmp_path, "w", "results", "generation=0", f"batch={first.pending()[0]}")
    os.makedirs(half, exist_ok=True)  # what a killed write leaves behind: files, no mark
    spark.range(3).select(F.col("id").alias("chunk"), F.col("id").alias("v")).write.mode("overwrite").parquet(half)
    os.remove(os.path.join(half, "_SUCCESS"))
    again = ChunkWork(spark, str(tmp_path / "w"))
    assert again.results().count() == sum(len(c) for c in calls)
    assert again.run(work) == 3 and again.run(work) == 0
    assert sorted(c for some in calls for c in some) == list(range(40))
    assert sorted((r["chunk"], r["v"]) for r in again.results().collect()) == [(i, 3 * i + 1) for i in range(40)]
    assert again.rewind() == 1 and len(again.pending()) == 5 and again.committed() == []
    with pytest.raises(ValueError):
        again.results()
    again.run(lambda c: c.withColumn("v", F.lit(7).cast("long")))
    assert again.results().select("v").distinct().collect() == [(7,)] and again.results().count() == 40


def test_rewound_before_work(spark, tmp_path):
    work = _work(spark, tmp_path / "w", 3, 1)
    assert work.rewind() == 1 and work.run(lambda c: c) == 1 and work.generation == 1


def test_odd_lists(spark, tmp_path):
    empty = _work(spark, tmp_path / "e", 0)
    assert empty.pending() == [] and empty.run(lambda c: c) == 0
    for bad in ("select 1 as chunk union all select 1", "select cast(null as int) as chunk", "select 1 as chunk, 2 as Batch"):
        with pytest.raises(ValueError):
            ChunkWork.create(spark.sql(bad), str(tmp_path / "b"), 2)
    with pytest.raises(ValueError):
        ChunkWork.create(spark.range(1).toDF("chunk"), str(tmp_path / "b"), 0)
    with pytest.raises(ValueError):
        ChunkWork(spark, str(tmp_path / "none"))
