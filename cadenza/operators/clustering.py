"""Clusterings that grow by splitting, initial partitions, and discriminative and nuisance training."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions.scalars import normal_cdf
from cadenza.functions import vectors as V
from cadenza.functions.shared import rewritten
from cadenza.operators.models import Mixture, assign, class_means, covariance_matrix, k_means

# Critical values of the corrected A squared by significance.
CRITICAL = {0.1: 0.656, 0.05: 0.787, 0.025: 0.918, 0.01: 1.092, 0.005: 1.227, 0.001: 1.552, 0.0001: 1.8692}
RANKINGS = ("count", "variance", "sum_variance", "largest_eigenvalue", "weight_variance", "score", "covariance", "eigenvalue_difference", "anderson_darling")


def anderson_darling(samples: DataFrame) -> DataFrame:
    """rec_id, n, a2: corrected A squared of each record's values against a normal distribution of its mean and deviation.

    Equal probabilities are one row with their count. Rows are dealt by ranges and ranked within them; the ranges' counts before give
    the rest, so no task sorts a whole record. Reverse ranks are n + 1 - i.
    """
    of = samples.groupBy(F.col("rec_id").alias("_of")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), normal_cdf((F.col("value") - F.col("mean")) / F.col("sd"))))
    each = samples.join(of, F.col("rec_id").eqNullSafe(F.col("_of"))).select("rec_id", "n", p.alias("p")).groupBy("rec_id", "n", "p").agg(F.count("*").alias("c"))
    dealt = rewritten(each.repartitionByRange(F.col("rec_id"), F.col("p")).withColumn("part", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("rec_id", "part").agg(F.sum("c").alias("here"))
    before = before.withColumn("before", F.sum("here").over(W.partitionBy("rec_id").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("here"))
    before = before.select(F.col("rec_id").alias("_rec"), F.col("part").alias("_part"), "before")
    inside = dealt.withColumn("upto", F.sum("c").over(W.partitionBy("rec_id", "part").orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow)))
    s = inside.join(before, F.col("rec_id").eqNullSafe(F.col("_rec")) & (F.col("part") == F.col("_part"))).withColumn("hi", F.col("before") + F.col("upto")).withColumn("lo", F.col("hi") - F.col("c"))
    n = F.col("n")
    # The sum of 2 i - 1 over the ranks i from lo + 1 to hi, and of 2 j - 1 over their reverse ranks.
    up, down = F.col("hi") * F.col("hi") - F.col("lo") * F.col("lo"), (n - F.col("lo")) * (n - F.col("lo")) - (n - F.col("hi")) * (n - F.col("hi"))
    per = s.groupBy("rec_id", "n").agg(F.sum(up * F.log("p") + down * F.log(1 - F.col("p"))).alias("t"))
    return per.select("rec_id", "n", ((-n - F.col("t") / n) * (1 + 0.75 / n + 2.25 / (n * n))).alias("a2"))


def _table(frames: DataFrame, at: np.ndarray) -> DataFrame:
    return frames.sparkSession.createDataFrame([(i, m.tolist()) for i, m in enumerate(at)], "id int, m array<double>")


def _direction(frames: DataFrame) -> tuple[np.ndarray, float]:
    """The leading principal direction and its variance."""
    values, vectors = np.linalg.eigh(covariance_matrix(frames))
    return vectors[:, -1], float(values[-1])


def g_means(frames: DataFrame, significance: float = 0.0001, most: int = 16, least: int = 20) -> np.ndarray:
    """Centroids; a cluster is split along its principal direction while its projections there are not normal."""
    mean = class_means(frames.withColumn("one", F.lit(0)), "one").first()["m"]
    at = np.array([mean])
    while len(at) < most:
        placed = rewritten(assign(frames, _table(frames, at)), "clusters")
        sizes = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}
        new = []
        for i, m in enumerate(at):
            own = placed.filter(F.col("cluster") == i)
            if sizes.get(i, 0) < least or len(at) + len(new) >= most:
                continue
            d, value = _direction(own)
            along = own.select(F.lit(0).alias("rec_id"), V.dot(F.col("x"), F.lit(d.tolist())).alias("value"))
            if anderson_darling(along).first()["a2"] > CRITICAL[significance]:
                new.append((i, m + d * math.sqrt(2 * value / math.pi), m - d * math.sqrt(2 * value / math.pi)))
        if not new:
            break
        gone = {i for i, _, _ in new}
        at = k_means(frames, np.array([m for i, m in enumerate(at) if i not in gone] + [m for _, a, b in new for m in (a, b)]), 20)
    return at


def _cluster_score(own: DataFrame, ranking: str) -> float:
    """A ranking that needs the cluster's whole covariance: d by d values on the driver."""
    cov = covariance_matrix(own)
    values, vectors = np.linalg.eigh(cov)
    if ranking == "anderson_darling":
        along = own.select(F.lit(0).alias("rec_id"), V.dot(F.col("x"), F.lit(vectors[:, -1].tolist())).alias("value"))
        return float(anderson_darling(along).first()["a2"])
    return float({"covariance": np.abs(cov[np.tril_indices(len(cov))]).sum(), "largest_eigenvalue": values[-1], "eigenvalue_difference": values[-1] - values[0]}[ranking])


def hierarchical(frames: DataFrame, most: int, ranking: str = "sum_variance", least: int = 50) -> DataFrame:
    """frames with cluster: the best ranked cluster is split in two at the mean of its principal direction, again and again."""
    if ranking not in RANKINGS:
        raise ValueError(f"ranking is one of {RANKINGS}")
    placed, done, clusters = frames.withColumn("cluster", F.lit(0)), set(), 1
    while clusters < most:
        per = placed.select("cluster", F.posexplode("x").alias("k", "v")).groupBy("cluster", "k").agg(F.var_pop("v").alias("s"), F.count("*").alias("n")).groupBy("cluster").agg(F.sum("s").alias("s"), F.max("s").alias("top"), F.first("n").alias("n"))
        open_ = per.filter((F.col("n") >= 2 * least) & ~F.col("cluster").isin(list(done) or [-1]))
        score = {"count": F.col("n"), "variance": F.col("top"), "sum_variance": F.col("s"), "weight_variance": F.col("n") * F.col("s"), "score": F.col("n") * F.log("s")}.get(ranking)
        if score is not None:
            best = open_.orderBy(F.desc(score), "cluster").first()
        else:  # a row per cluster
            best = max(open_.orderBy("cluster").collect(), key=lambda r: _cluster_score(placed.filter(F.col("cluster") == r["cluster"]), ranking), default=None)
        if best is None:
            break
        own = placed.filter(F.col("cluster") == best["cluster"])
        d, _ = _direction(own)
        along = V.dot(F.col("x"), F.lit(d.tolist()))
        cut = own.agg(F.avg(along)).first()[0]
        upper = own.filter(along > cut).count()
        if min(upper, best["n"] - upper) < least:
            done.add(best["cluster"])
            continue
        # Written, so that a later split doesn't repeat the earlier ones.
        placed = rewritten(placed.withColumn("cluster", F.when((F.col("cluster") == best["cluster"]) & (along > cut), clusters).otherwise(F.col("cluster"))), "clusters")
        clusters += 1
    return placed


def nuisance_basis(frames: DataFrame, key: str, rank: int) -> np.ndarray:
    """[rank, d]: leading directions of the scatter within the classes, to be removed from every frame."""
    means = class_means(frames, key).withColumnRenamed("id", key)
    centred = frames.join(means, key).withColumn("x", V.sub(F.col("x"), F.col("m")))
    values, vectors = np.linalg.eigh(covariance_matrix(centred))
    return vectors.T[np.argsort(-values)[:rank]]


def block_nuisance_bases(frames: DataFrame, key: str, rank: int, blocks: int) -> list[np.ndarray]:
    """A basis [rank, d / blocks] for each of so many equal parts of x, from the blocks of one scatter within the classes."""
    means = class_means(frames, key).withColumnRenamed("id", key)  # a row per class
    within = covariance_matrix(frames.join(means, key).withColumn("x", V.sub(F.col("x"), F.col("m"))))
    if len(within) % blocks:
        raise ValueError("the width is not a multiple of the number of blocks")
    size, bases = len(within) // blocks, []
    for b in range(blocks):
        values, vectors = np.linalg.eigh(within[b * size : (b + 1) * size, b * size : (b + 1) * size])
        bases.append(vectors.T[np.argsort(-values)[:rank]])
    return bases


def remove_block_nuisance(frames: DataFrame, bases: list[np.ndarray]) -> DataFrame:
    """Each part of x without the directions of its own basis."""
    size, parts = bases[0].shape[1], []
    for b, basis in enumerate(bases):
        x = F.slice("x", b * size + 1, size)
        y = x
        for v in basis.tolist():
            y = V.sub(y, V.scale(F.lit(v), V.dot(x, F.lit(v))))
        parts.append(y)
    return frames.withColumn("x", F.concat(*parts))


def remove_nuisance(frames: DataFrame, basis: np.ndarray, blocks: int = 1) -> DataFrame:
    """``x - sum of v (v . x)`` over the rows of ``basis``; with ``blocks``, on each of so many equal parts of x."""

    def clean(x):
        y = x
        for v in basis.tolist():
            y = V.sub(y, V.scale(F.lit(v), V.dot(x, F.lit(v))))
        return y

    size = basis.shape[1]
    return frames.withColumn("x", clean(F.col("x")) if blocks == 1 else F.concat(*[clean(F.slice("x", b * size + 1, size)) for b in range(blocks)]))


def sparse_pca(rows: DataFrame, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, squared singular values) of the centred rows.

    By the d by d scatter, added up in the tasks; where rows are fewer than dimensions, by their n by n Gram matrix on the driver.
    """
    n, d = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if n >= d:
        values, vectors = np.linalg.eigh(covariance_matrix(rows) * n)
        order = np.argsort(-values)[:keep]
        return vectors[:, order].T, values[order]
    x = np.array([r["x"] for r in rows.collect()], np.float32)
    x = x - x.mean(0)
    values, vectors = np.linalg.eigh((x @ x.T).astype(np.float64))
    order = np.argsort(-values)[:keep]
    return (vectors[:, order].T @ x) / np.sqrt(np.maximum(values[order], 1e-30))[:, None], values[order]


def _class_shares(frames: DataFrame, models: list[Mixture], keys: list[str], scale: float) -> DataFrame:
    """keys, share: each segment's posteriors of the classes, the softmax of ``scale`` times its summed log likelihoods."""
    d, names = models[0].means.shape[1], [f"l{i}" for i in range(len(models))]
    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in keys)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(len(keys)).flatten(), np.float64).reshape(-1, d)
            logs = [m.score(x) for m in models]
            tops = [v.max(1) for v in logs]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array(t + np.log(np.exp(v - t[:, None]).sum(1))) for v, t in zip(logs, tops, strict=True)]], [*keys, *names])

    summed = frames.select(*keys, "x").mapInArrow(scores, f"{kinds}, " + ", ".join(f"{c} double" for c in names)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    logs = F.array(*[scale * F.col(c) for c in names])
    return summed.select(*keys, F.transform(logs, lambda v: F.exp(v - V.log_sum_exp(logs))).alias("share"))


def _new_weights(weights: np.ndarray, num: np.ndarray, den: np.ndarray, least: float) -> np.ndarray:
    """50 steps of ``w = num + k w`` with ``k = max(den / w0) - den / w0``, brought to a sum of one at the end and floored.

    The steps aren't normalised, as in the surveyed source; a common factor is carried along so that they can't overflow.
    """
    ratio = den / weights
    k, w, factor = ratio.max() - ratio, weights.copy(), 1.0
    for _ in range(50):
        w = num * factor + k * w
        total = w.sum()
        if total <= 0:
            return weights
        w, factor = w / total, factor / total
    return np.maximum(w, least)


def mmie(frames: DataFrame, models: list[Mixture], key: str, smoothing: float = 2.0, segment: list[str] | None = None, scale: float = 1.0, least_weight: float = 1e-10) -> list[Mixture]:
    """One extended Baum-Welch update of each class's mixture, weights included, against all classes.

    ``key`` is the class's place in ``models``. Numerators come from frames of the class, denominators from all frames weighted by the
    classes' posteriors: those of a segment (``key`` and the columns ``segment``), or of each frame without ``segment``. Each
    component's constant starts at half ``smoothing`` times its denominator, grows by a tenth until its variances are positive and is
    then doubled.
    """
    n_c, n_k, d = len(models), len(models[0].weights), models[0].means.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n_c, n_k, 1 + 2 * d))
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, d)
            logs = np.stack([m.score(x) for m in models], 1)
            top = logs.max(2, keepdims=True)
            whole = top + np.log(np.exp(logs - top).sum(2, keepdims=True))
            own = np.exp(logs - whole)
            if segment:
                share = np.asarray(batch.column(2).flatten(), np.float64).reshape(-1, n_c)
            else:
                share = np.exp(scale * (whole[:, :, 0] - whole[:, :, 0].max(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
            moments = np.concatenate([np.ones((len(x), 1)), x, x * x], 1)
            for i in range(n_c):
                sums[0, i] += own[c == i, i].T @ moments[c == i]
                sums[1, i] += (own[:, i] * share[:, i, None]).T @ moments
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["i", "v"])

    rows = frames.withColumn(key, F.col(key).cast("int"))
    if segment:
        rows = rows.join(_class_shares(rows, models, [key, *segment], scale), [key, *segment])
    rows = rows.select(key, "x", *(["share"] if segment else [])).mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    sums = np.array([r["v"] for r in rows]).reshape(2, n_c, n_k, 1 + 2 * d)
    out = []
    for i, m in enumerate(models):
        num, den = sums[0, i], sums[1, i]
        mean, var = m.means.copy(), m.variances.copy()

        def update(k: int, constant: float, m: Mixture = m, num: np.ndarray = num, den: np.ndarray = den) -> tuple[np.ndarray, np.ndarray] | None:
            total = num[k, 0] - den[k, 0] + constant
            if total <= 0:
                return None
            mu = (num[k, 1 : d + 1] - den[k, 1 : d + 1] + constant * m.means[k]) / total
            s = (num[k, d + 1 :] - den[k, d + 1 :] + constant * (m.variances[k] + m.means[k] ** 2)) / total - mu**2
            return (mu, s) if (s > 0).all() else None

        for k in range(n_k):
            constant = max(smoothing * den[k, 0] / 2, 1e-6)
            for _ in range(100):
                if update(k, constant):
                    mean[k], var[k] = update(k, 2 * constant) or (mean[k], var[k])
                    break
                constant *= 1.1
        out.append(Mixture(_new_weights(m.weights, num[:, 0], den[:, 0], least_weight), mean, var))
    return out
