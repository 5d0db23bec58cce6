"""The driver's tables as frames, samples, segments and diary rows, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.plans.catalog import table

FRAMES = """frames AS (SELECT label AS rec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
  list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings),
cells AS (SELECT rec_id, frame_idx, unnest(range(len(x))) AS k, unnest(x) AS v FROM frames)"""
SAMPLES = """samples AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  value, event_type FROM events)"""
DIARY = """diary AS (SELECT o.o_orderkey AS _id, epoch_ms(o.o_orderdate) AS time, strftime(o.o_orderdate, '%Y/%m/%d') AS date,
  count(l.l_orderkey) AS n, round(100.0 * count(*) FILTER (l.l_returnflag = 'R') / count(*), 6) AS percentage
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL)"""


def r6(x: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("rec_id").orderBy("vec_id")) - 1
    return table(spark, sf_dir, "embeddings").withColumnRenamed("label", "rec_id").select("rec_id", place.cast("long").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("x"))


def cells(df: DataFrame, *keys: str) -> DataFrame:
    """One row per component: keys, k, v (rounded)."""
    return df.select(*keys, F.posexplode("x").alias("k", "v")).select(*keys, F.col("k").cast("long").alias("k"), r6(F.col("v")).alias("v"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("rec_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").withColumnRenamed("user_id", "rec_id").select("rec_id", place.cast("long").alias("idx"), "value", "event_type")


def diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("own"))
    lines = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(100.0 * F.sum("own") / F.count("*"), 6).alias("percentage"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.col("o_orderkey").alias("_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("time"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("date"), "n", "percentage"
    )
