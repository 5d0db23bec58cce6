"""Connected components of a table of links, by alternating large-star and small-star rounds on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import Tables, written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Each vertex's neighbours (larger: those above it; else those below it and itself) join the least one it knows."""
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))) if larger else edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    near = both.join(least, "x")
    moved = near.filter("y > x") if larger else near.filter("y <> m")
    out = moved.select(F.col("y").alias("x"), F.col("m").alias("y"))
    if not larger:
        out = out.unionByName(least.select("x", F.col("m").alias("y")))
    return out.filter("x <> y").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every vertex of ``links`` (x, y): root is the least vertex it is connected with.

    Every round is written, so lineage stays short. They end when each vertex has one link at most and none from a vertex that is
    linked to, after about log(size) rounds. Loops and repeated links are harmless; an empty table has no components.
    """
    tables, turn = Tables(links.sparkSession), 0
    edges = tables.keep(_star(links.select("x", "y"), False), "links-0")
    while True:
        ends = edges.select(F.col("x").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("y").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        ends = ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if ends.filter("out > 1 or (out = 1 and into = 1)").isEmpty():
            found = written(ends.filter("out = 0").select(F.col("v").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("x").alias("id"), F.col("y").alias("root"))), "components")
            tables.drop()
            return found
        edges = tables.keep(_star(_star(edges, True), False), f"links-{turn + 1}")
        tables.drop(f"links-{turn}")
        turn += 1
