"""Approximate nearest neighbours by cosine: inverted lists scanned with adaptive dimension sampling.

Vectors are scaled to length 1 and rotated at random, so that the first columns of a difference estimate the whole. Lists are the
cells of centroids fitted on a bounded sample; every vector is in one list. A list that holds too many vectors is cut by centroids of
its own, fitted on a bounded sample of it, and so are its parts, so that lists don't grow with the table. Lists are dealt to blocks of
bounded size, and a query probes the lists of its nearest centroids on each level. A block is scanned by blocks of columns: a candidate is dropped as soon as
its partial distance refutes, at the chosen level, that it is as near as the k-th found. The nearest list is scanned first, and the k-th
distance found in all of its blocks goes with the query to the other lists. Equal vectors are one until the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.shared import bounded, join_hot, small_batches, written

COLUMNS = 16
LEVEL = 2.1
#: Vectors and queries of a block, on average.
VECTORS, QUERIES = 1024, 256
#: Vectors of a list on average that its own centroids are fitted on; parts that a list is cut into at most; levels below the first.
FITTED, PARTS, LEVELS = 4096, 256, 6
_CELL = "list long, u long, x array<double>, nearest boolean"


def _rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _centroids(sample: np.ndarray, lists: int, seed: int, turns: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors; a cell without members starts again at a random one."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(turns):
        cell = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, cell, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), sample[rng.integers(0, len(sample), lists)])
    return at


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def _probed(x: np.ndarray, u: pa.Array, centroids: np.ndarray, probes: int, names: np.ndarray) -> pa.RecordBatch:
    """list, u, x, nearest: each row of ``x`` once for each of its ``probes`` nearest centroids, which have ``names``."""
    close = x @ centroids.T
    near = np.argpartition(-close, probes - 1, axis=1)[:, :probes] if probes < len(centroids) else np.tile(np.arange(len(centroids)), (len(x), 1))
    nearest = np.zeros(near.shape, bool)
    nearest[np.arange(len(x)), np.take_along_axis(close, near, 1).argmax(1)] = True
    row = np.repeat(np.arange(len(x)), near.shape[1])
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * x.shape[1]), pa.array(x[row].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(names[near.ravel()]), u.take(pa.array(row)), vectors, pa.array(nearest.ravel())], ["list", "u", "x", "nearest"])


def _cell_rows(turn: np.ndarray, centroids: np.ndarray, probes: int, names: np.ndarray):
    """(u, x) -> (list, u, rotated unit vector, whether it is the nearest) for the nearest ``probes`` centroids, which have ``names``."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), len(turn))
            yield _probed((x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn, batch.column(0), centroids, probes, names)

    return run


def _part_rows(batches):
    """(list, block of u, x, nearest; the list's own centroids, probes) -> the rows by parts of the list."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows, flat = batch.column(1)[i].values, np.asarray(batch.column(2)[i].values)
            x = np.asarray(rows.field("x").flatten()).reshape(len(rows), -1)
            centroids = flat.reshape(-1, x.shape[1])
            names = batch.column(0)[i].as_py() * PARTS + np.arange(len(centroids))
            out = _probed(x, rows.field("u"), centroids, min(batch.column(3)[i].as_py(), len(centroids)), names)
            first = np.repeat(rows.field("nearest").to_numpy(zero_copy_only=False), out.num_rows // len(x))
            yield out.set_column(3, "nearest", pa.array(out.column(3).to_numpy(zero_copy_only=False) & first))


def _fit_parts(k: int, recall: float, seed: int, most: int):
    """Sample of one list (list, n, u, x) -> its own centroids and the probes that ``recall`` takes; no row if they don't divide it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("u").combine_chunks()
        x = np.stack(table.column("x").to_numpy())
        parts = min(PARTS, -(-8 * table.column("n")[0].as_py() // most), len(x) // 4)
        centroids = _centroids(x, parts, seed) if parts > 1 else x[:1]
        divided = np.bincount((x @ centroids.T).argmax(1)).max() <= 0.9 * len(x)
        rows = [(table.column("list")[0].as_py(), centroids.ravel().tolist(), _probes(x, centroids, k, recall, seed))] if divided else []
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.list_(pa.float64()), pa.int32()))], ["list", "centroids", "probes"])

    return run


def _divided(cells: DataFrame, questions: DataFrame, k: int, recall: float, seed: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``cells`` (list, u, x) and ``questions`` (and nearest) with lists of more than ``most`` vectors cut into parts, level by level."""
    for level in range(LEVELS):
        large = written(cells.groupBy("list").agg(F.count("*").alias("n")).filter(F.col("n") > most), "vector-large")
        if large.isEmpty():
            break
        picked = F.pmod(F.xxhash64(F.lit(level + 3), "u"), F.lit(1 << 30)) < F.ceil(F.lit(float(FITTED << 30)) / F.col("n"))
        sample = cells.join(bounded(large), "list").filter(picked).select("list", "n", "u", "x")
        cuts = written(sample.groupBy("list").applyInArrow(_fit_parts(k, recall, seed, most), "list long, centroids array<double>, probes int"), "vector-cuts")
        if cuts.isEmpty():
            break
        cut = bounded(cuts.select("list"))

        def dealt(rows: DataFrame, size: int, cuts: DataFrame, cut: DataFrame = cut) -> DataFrame:
            blocks = join_hot(_blocks(rows.join(cut, "list", "left_semi"), size, "rows", "nearest"), cuts, "list", "part")
            parts = blocks.select("list", "rows", "centroids", "probes").mapInArrow(_part_rows, _CELL)
            # What isn't cut is the first part of itself.
            return parts.unionByName(rows.join(cut, "list", "left_anti").select((F.col("list") * PARTS).alias("list"), "u", "x", "nearest"))

        cells = written(dealt(cells.withColumn("nearest", F.lit(True)), VECTORS, cuts.withColumn("probes", F.lit(1))).drop("nearest"), "vector-cells")
        sizes = cells.groupBy("list").agg(F.count("*").alias("n")).withColumn("of", F.floor(F.col("list") / PARTS))
        upto = F.sum("n").over(W.partitionBy("of").orderBy("n", "list"))  # at most PARTS rows each
        # Enough parts for k other vectors in any case, empty ones not counted.
        least = sizes.withColumn("upto", upto).groupBy(F.col("of").alias("list")).agg(F.count("*").alias("parts"), F.count_if(F.col("upto") < k + 1).alias("few"))
        width = F.size("centroids") / F.lit(cells.select(F.size("x")).first()[0])
        probes = F.greatest("probes", (width - F.col("parts") + F.col("few") + 1).cast("int"))
        probed = written(cuts.join(bounded(least), "list").select("list", "centroids", probes.alias("probes")), "vector-cuts")
        questions = written(dealt(questions, QUERIES, probed), "query-cells")
    return cells, questions


def scan_block(v: np.ndarray, q: np.ndarray, k: int, bounds: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, squared distances) of the up to ``k`` nearest rows of ``v`` found for each row of ``q``.

    ``bounds``: distances of k rows that are known elsewhere; what is farther isn't returned. Without one (infinite) the first rows give it.
    """
    dim, out = v.shape[1], []
    for row, known in zip(q, np.full(len(q), np.inf) if bounds is None else bounds, strict=True):
        head = min(len(v), max(4 * k, 32)) if known == np.inf else 0
        near = ((v[:head] - row) ** 2).sum(1)
        bound = np.partition(near, k - 1)[k - 1] if head >= k else known
        live, partial = np.arange(head, len(v)), np.zeros(len(v) - head)
        for c in range(0, dim, COLUMNS):
            partial = partial + ((v[live, c : c + COLUMNS] - row[c : c + COLUMNS]) ** 2).sum(1)
            seen = min(c + COLUMNS, dim)
            stay = partial * (dim / seen) <= bound * (1 + LEVEL / np.sqrt(seen)) ** 2 if seen < dim else partial <= bound
            live, partial = live[stay], partial[stay]
        ids, far = np.concatenate([np.arange(head), live]), np.concatenate([near, partial])
        best = np.argsort(far, kind="stable")[:k]
        out.append((ids[best], far[best]))
    return out


def _scan_rows(k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                vs, qs = batch.column(0)[i].values, batch.column(1)[i].values
                vu, qu = vs.field("u").to_numpy(), qs.field("u").to_numpy()
                v = np.asarray(vs.field("x").flatten()).reshape(len(vu), -1)
                q = np.asarray(qs.field("x").flatten()).reshape(len(qu), -1)
                found = scan_block(v, q, k, qs.field("bound").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qu, [len(a) for a, _ in found])), pa.array(vu[np.concatenate([a for a, _ in found])]), pa.array(np.concatenate([d for _, d in found]))], ["qu", "u", "far"])

    return run


def _blocks(cells: DataFrame, size: int, name: str, *more: str) -> DataFrame:
    """(list, part, ``name``: array of (u, x, more)), blocks of about ``size`` rows: large lists are dealt over several."""
    sizes = cells.groupBy("list").agg(F.ceil(F.count("*") / F.lit(size)).alias("parts"))
    dealt = cells.join(bounded(sizes), "list").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")))
    return dealt.groupBy("list", "part").agg(F.collect_list(F.struct("u", "x", *more)).alias(name))


def usable(x: Column) -> Column:
    """Neither null nor empty nor zero, and no component null or non-finite."""
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & ok & F.exists(x, lambda v: v != 0), F.lit(False))


def _cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, seed: int, queries: int = 256) -> int:
    """Lists that a query must probe for ``recall`` of its ``k`` nearest, as measured on the sample by brute force.

    In the whole table the nearest are nearer than in a sample of it, so their lists come earlier.
    """
    rng = np.random.default_rng(seed)
    asked = rng.choice(len(sample), min(queries, len(sample)), replace=False)
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    count = min(k, len(sample) - 1)
    if count < 1:
        return len(centroids)
    best = np.argpartition(-score, count - 1, axis=1)[:, :count]
    cell = (sample @ centroids.T).argmax(1)
    place = np.argsort(np.argsort(-(sample[asked] @ centroids.T), axis=1), axis=1)  # of each list for each query
    return int(np.quantile(place[np.arange(len(asked))[:, None], cell[best]], recall, method="higher")) + 1


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, sample_rows: int = 40_000, recall: float = 0.97, seed: int = 7, most: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row among all other rows.

    The score is the cosine of the original vectors in double precision; ties go to the smaller id. Vectors that are null, empty,
    zero, of another length than the most common one, or that hold null or non-finite components take no part, nor do rows without
    an id. Rows that repeat an id are one candidate, that of the best score, and never one of their own id.

    Centroids, a list for every 16 at most, are fitted on about ``sample_rows`` distinct vectors (the bound); every vector is indexed. A
    query probes as many lists as gave ``recall`` on the sample, so few where vectors cluster and most where they don't. A list of more
    than ``most`` vectors is cut into up to 256 parts by centroids fitted on about 4,096 of its vectors, and its parts are cut again;
    what a query probes of its parts is measured on that sample, so ``recall`` is that of a level. A list of nearly one direction can't be
    cut and stays whole, in blocks. Distinct vectors are named by a 64-bit hash, which is expected to confuse 2.7 pairs of 10^10. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    # Adding 0.0 makes -0.0 the 0.0 that it equals.
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + 0.0).alias("x"), is_query.alias("is_query")).filter(usable(F.col("x")) & F.col("id").isNotNull())
    dims = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    dim = dims[0]["d"]
    rows = rows.filter(F.size("x") == dim).withColumn("u", F.xxhash64(F.lit(1), "x"))
    # One row per distinct vector with its k + 1 least ids: a query needs no more of them than that.
    ids = rows.select("u", "x", "id").distinct().withColumn("place", F.row_number().over(W.partitionBy("u").orderBy("id"))).filter(F.col("place") <= k + 1)
    distinct = written(ids.groupBy("u").agg(F.first("x").alias("x"), F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    asked = written(rows.filter("is_query").select("id", "u").distinct(), "queries")

    n = distinct.count()
    keep = min(1.0, sample_rows / n)
    sample = distinct.filter(F.pmod(F.xxhash64(F.lit(2), "u"), F.lit(1 << 30)) < int(keep * (1 << 30)) + 1).select("x").toPandas()["x"]
    turn = _rotation(dim, seed)
    sample = np.stack([np.asarray(s) for s in sample]) if len(sample) else np.ones((1, dim))
    sample = (sample / np.linalg.norm(sample, axis=1, keepdims=True)) @ turn
    lists = int(max(1, min(np.sqrt(n) / 2, len(sample) / 16)))
    centroids = _centroids(sample, lists, seed)
    cells = written(distinct.select("u", "x").mapInArrow(_cell_rows(turn, centroids, 1, np.arange(lists)), _CELL).drop("nearest"), "vector-cells")
    sizes = {r["list"]: r["count"] for r in cells.groupBy("list").count().collect()}  # a row per list
    names = np.array(sorted(sizes))
    # Enough lists for k other vectors in any case.
    least = 1 + int(np.searchsorted(np.cumsum(sorted(sizes.values())), k + 1))
    probes = min(len(names), max(least, _probes(sample, centroids[names], k, recall, seed)))
    questions = written(distinct.select("u", "x").join(asked.select("u").distinct(), "u", "left_semi").mapInArrow(_cell_rows(turn, centroids[names], probes, names), _CELL), "query-cells")
    if max(sizes.values()) > most:
        cells, questions = _divided(cells, questions, k, recall, seed, most)
    blocks = written(_blocks(cells, VECTORS, "vs"), "vector-blocks")

    def kept(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(W.partitionBy("qu").orderBy("far", "u"))).filter(F.col("place") <= k + 1).select("qu", "u", "far")

    def scanned(some: DataFrame) -> DataFrame:
        return blocks.join(_blocks(some, QUERIES, "qs", "bound"), "list").select("vs", "qs").mapInArrow(_scan_rows(k + 1), "qu long, u long, far double")

    best = written(kept(scanned(questions.filter("nearest").withColumn("bound", F.lit(float("inf"))))), "vector-first")
    if probes > 1 or max(sizes.values()) > most:
        known = best.groupBy(F.col("qu").alias("u")).agg(F.count("*").alias("n"), F.max("far").alias("bound"))
        bound = F.when(F.col("n") == k + 1, F.col("bound")).otherwise(float("inf"))
        others = questions.filter("not nearest").join(known, "u", "left").select("list", "u", "x", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
        best = written(kept(best.unionByName(scanned(written(others, "query-others")))), "vector-found")
    best = best.select("qu", "u")

    own = distinct.select(F.col("u").alias("qu"), F.col("x").alias("qx"))
    scored = best.join(distinct, "u").join(own, "qu").select("qu", "ids", _cosine(F.col("qx"), F.col("x")).alias("score"))
    candidates = asked.withColumnRenamed("id", "query_id").join(scored, asked["u"] == scored["qu"]).select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    candidates = candidates.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
