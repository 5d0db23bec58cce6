import pytest
from pyspark.sql import functions as F

from cadenza.llm import shared
from cadenza.llm.ngram_join import ngram_components
from cadenza.llm.shared import Tables, chunk_of, free_name, id_bounds, join_hot


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_a_hot_key(spark, monkeypatch, how):
    left = spark.createDataFrame([(i, 1 if i % 10 else i) for i in range(500)], "v long, y long")
    right = spark.createDataFrame([(1, "hot"), (20, "x"), (9999, "none")], "y long, name string")
    want = sorted(left.join(right, "y", how).select("v", "y", "name").collect(), key=str)
    for most in (shared.BROADCAST_BYTES, 0):
        monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
        assert sorted(join_hot(left, right, "y", "v", how).select("v", "y", "name").collect(), key=str) == want


def test_ngram_join_without_any_broadcast(spark, docs, monkeypatch):
    want = sorted(map(tuple, ngram_components(docs, k=3, threshold=(9, 10)).collect()))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, ngram_components(docs, k=3, threshold=(9, 10)).collect())) == want


def test_chunks_of_hot_and_missing_ids(spark):
    """Chunks ascend with ids; a hot id and missing ids are dealt over several chunks, descending with ties."""
    rows = spark.range(6000).select(F.when(F.col("id") < 2000, 77).when(F.col("id") < 3000, None).otherwise(F.col("id") % 900).alias("key"), F.shiftrightunsigned(F.xxhash64("id"), 1).alias("tie"))
    cuts = id_bounds(rows, "key", 100)
    found = rows.withColumn("chunk", chunk_of(F.col("key"), F.col("tie"), cuts)).collect()
    order = sorted((r for r in found if r.key is not None), key=lambda r: (r.key, -r.tie))
    assert [r.chunk for r in order] == sorted(r.chunk for r in order) and order[0].chunk >= 0
    assert len({r.chunk for r in found if r.key == 77}) > 5
    none = sorted((r for r in found if r.key is None), key=lambda r: r.tie)
    assert [r.chunk for r in none] == sorted((r.chunk for r in none), reverse=True) and none[0].chunk < 0 and len({r.chunk for r in none}) > 5
    sizes = {}
    for r in found:
        sizes[r.chunk] = sizes.get(r.chunk, 0) + 1
    assert max(sizes.values()) < 500


def test_names_and_tables(spark):
    assert free_name(["a", "Key", "key_"], "key") == "key__" and free_name([], "key") == "key"
    tables = Tables(spark)
    kept = tables.keep(spark.range(3), "some")
    assert kept.count() == 3
    path = tables.paths["some"][0].removeprefix("file://")
    tables.drop()
    import os

    assert not os.path.exists(path)
