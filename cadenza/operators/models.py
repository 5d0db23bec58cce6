"""Statistical models: Gaussians, mixtures, clusterings, projections and chains.

Sufficient statistics are sums grouped by component (partial sums in each task, then merged), so an iteration moves a few vectors
per component; parameters are small and live on the driver between iterations as literals or one-row tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cadenza.functions import vectors as V
from cadenza.functions.shared import only_row

VARIANCE_FLOOR, WEIGHT_FLOOR = 1e-10, 1e-10
#: Frames times components times dimensions that a task scores at once.
SCORED = 1 << 21


def class_means(frames: DataFrame, key: str) -> DataFrame:
    """id, m: the mean vector of each class."""
    per = frames.select(key, F.posexplode("x").alias("k", "v")).groupBy(key, "k").agg(F.avg("v").alias("m"))
    return per.groupBy(F.col(key).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda c: c["m"]).alias("m"))


def class_gaussians(frames: DataFrame, key: str) -> DataFrame:
    """id, weight, m, s: diagonal maximum likelihood Gaussians of the classes, with floored variances and priors."""
    per = frames.select(key, F.posexplode("x").alias("k", "v")).groupBy(key, "k").agg(F.avg("v").alias("m"), F.greatest(F.var_pop("v"), F.lit(VARIANCE_FLOOR)).alias("s"), F.count("*").alias("n"))
    each = per.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("c"), F.max("n").alias("n"))
    total = each.agg(F.sum("n").alias("t"))
    return each.crossJoin(F.broadcast(total)).select("id", (F.col("n") / F.col("t")).alias("weight"), F.transform("c", lambda c: c["m"]).alias("m"), F.transform("c", lambda c: c["s"]).alias("s"))


def _together(models: DataFrame, *fields: str) -> DataFrame:
    """One row: the components (a model's size, not the data's) as an array by id."""
    return models.agg(F.array_sort(F.collect_list(F.struct("id", *fields))).alias("components"))


def assign(frames: DataFrame, centroids: DataFrame) -> DataFrame:
    """frames with cluster and far: the nearest centroid by Euclidean distance, ties to the lowest id."""
    near = F.array_min(F.transform("components", lambda c: F.struct(F.round(V.euclidean(F.col("x"), c["m"]), 9).alias("far"), c["id"].alias("id"))))
    joined = frames.crossJoin(F.broadcast(_together(centroids, "m"))).withColumn("_near", near)
    return joined.withColumn("cluster", F.col("_near.id")).withColumn("far", F.col("_near.far")).drop("components", "_near")


def log_densities(frames: DataFrame, gaussians: DataFrame) -> DataFrame:
    """frames with scores: array of (id, weight, score), the log density of each diagonal Gaussian.

    The Gaussians (a model's size) go to the driver; frames are scored by Arrow batches.
    """
    model = gaussians.select("id", "weight", "m", "s").orderBy("id").collect()
    fields = {f.name: f.dataType for f in gaussians.schema}
    kind = T.ArrayType(T.StructType([T.StructField("id", fields["id"]), T.StructField("weight", T.DoubleType()), T.StructField("score", T.DoubleType())]))
    means, variances = (np.array([r[c] for r in model], np.float64).reshape(len(model), -1) for c in ("m", "s"))
    names, places = [r["id"] for r in model], frames.columns.index("x")
    id_type = to_arrow_type(fields["id"])
    spread = np.log(2 * np.pi * variances).sum(1)
    weights = np.array([r["weight"] for r in model], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = np.asarray(batch.column(places).flatten(), np.float64).reshape(batch.num_rows, -1)
                score = -0.5 * (((x[:, None] - means[None]) ** 2 / variances[None]).sum(2) + spread)
                n = batch.num_rows
                parts = pa.StructArray.from_arrays([pa.array(names * n, id_type), pa.array(np.tile(weights, n)), pa.array(score.ravel())], ["id", "weight", "score"])
                scores = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(names)), parts)
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "scores"])

    return frames.mapInArrow(run, T.StructType([*frames.schema, T.StructField("scores", kind)]))


def mixture_posteriors(scored: DataFrame) -> DataFrame:
    """Adds score, the mixture's log density, and posteriors: array of (id, p)."""
    logs = F.transform("scores", lambda s: F.log(s["weight"]) + s["score"])
    out = scored.withColumn("score", V.log_sum_exp(logs))
    return out.withColumn("posteriors", F.transform("scores", lambda s: F.struct(s["id"].alias("id"), F.exp(F.log(s["weight"]) + s["score"] - F.col("score")).alias("p"))))


def interpolate_gaussians(gaussians: DataFrame, towards: DataFrame, weight: float) -> DataFrame:
    """Means and variances moved by ``weight`` to those of the one Gaussian ``towards`` (m, s)."""
    other = F.broadcast(only_row(towards, "towards").select(F.col("m").alias("om"), F.col("s").alias("os")))
    joined = gaussians.crossJoin(other)
    return joined.withColumn("m", V.interpolate(F.col("m"), F.col("om"), weight)).withColumn("s", V.interpolate(F.col("s"), F.col("os"), weight)).drop("om", "os")


def two_pass_gaussian(frames: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) in two passes: the mean first, then products of centred frames, summed in each task."""
    mean = _mean_vector(frames)
    lower = np.tril_indices(len(mean))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((len(mean), len(mean)))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, len(mean)) - mean
            n, sums = n + len(x), sums + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(lower[0]), pa.array(lower[1]), pa.array(np.full(len(lower[0]), n)), pa.array(sums[lower])], ["i", "j", "n", "v"])

    rows = frames.select("x").mapInArrow(partial, "i long, j long, n long, v double").groupBy("i", "j").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
    out = np.zeros((len(mean), len(mean)))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return mean, out


def full_covariance(frames: DataFrame) -> DataFrame:
    """i, j, cov (j <= i): the population covariance of all frames from per-task Gram matrices."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, None, None
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            if len(x):
                n, first, second = n + len(x), x.sum(0) if first is None else first + x.sum(0), x.T @ x if second is None else second + x.T @ x
        if n:
            i, j = np.tril_indices(len(first))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n)), pa.array(first[i]), pa.array(first[j]), pa.array(second[i, j])], ["i", "j", "n", "a", "b", "ab"])

    sums = frames.select("x").mapInArrow(partial, "i int, j int, n long, a double, b double, ab double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "ab")])
    return sums.select("i", "j", (F.col("ab") / F.col("n") - F.col("a") / F.col("n") * F.col("b") / F.col("n")).alias("cov"))


def covariance_matrix(frames: DataFrame) -> np.ndarray:
    """The covariance on the driver: dimension squared values, whatever the number of frames."""
    rows = full_covariance(frames).collect()
    d = max((r["i"] for r in rows), default=-1) + 1
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["cov"]
    return out


@dataclass
class Projection:
    """``y = rows @ (x - mean)``, rows by descending eigenvalue."""

    mean: np.ndarray
    rows: np.ndarray
    values: np.ndarray

    def apply(self, frames: DataFrame, keep: int | None = None) -> DataFrame:
        rows = self.rows[:keep].tolist()
        return frames.withColumn("x", V.linear(rows, V.sub(F.col("x"), F.lit(self.mean.tolist()))))

    def add_to(self, frames: DataFrame, keep: int) -> DataFrame:
        """In place: the first ``keep`` components are increased by their projections, the rest become 0."""
        y = V.linear(self.rows[:keep].tolist(), V.sub(F.col("x"), F.lit(self.mean.tolist())))
        return frames.withColumn("x", F.concat(V.add(F.slice("x", 1, keep), y), F.array_repeat(F.lit(0.0), F.size("x") - keep)))


def _mean_vector(frames: DataFrame) -> np.ndarray:
    rows = frames.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").collect()
    return np.array([r["m"] for r in rows])


def pca(frames: DataFrame) -> Projection:
    """Principal components of the population covariance."""
    values, vectors = np.linalg.eigh(covariance_matrix(frames))
    order = np.argsort(-values)
    return Projection(_mean_vector(frames), vectors.T[order], values[order])


def lda(frames: DataFrame, key: str) -> Projection:
    """Linear discriminants: eigenvectors of pinv(Sw) Sb, at most classes - 1 of them."""
    counts = {r["id"]: r["n"] for r in frames.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).collect()}
    means = {r["id"]: np.array(r["m"]) for r in class_means(frames, key).collect()}
    mean, total = _mean_vector(frames), sum(counts.values())
    between = sum(counts[c] / total * np.outer(means[c] - mean, means[c] - mean) for c in counts)
    within = covariance_matrix(frames) - between
    values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
    order = np.argsort(-values.real)[: max(1, len(counts) - 1)]
    return Projection(mean, vectors.T[order].real, values.real[order])


@dataclass
class Mixture:
    """A diagonal mixture: weights [n], means [n, d], variances [n, d]."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    history: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """[frame, component] log of weight times density."""
        apart = ((x[:, None] - self.means[None]) ** 2 / self.variances[None]).sum(2)
        return np.log(self.weights) - 0.5 * (apart + np.log(2 * np.pi * self.variances).sum(1))


def em_statistics(frames: DataFrame, mixture: Mixture) -> dict[str, np.ndarray]:
    """Occupancies, first and second moments, log likelihood and count, merged from one partial row per task and component."""
    schema = "c int, occ double, first array<double>, second array<double>, ll double, n long"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_c, d = mixture.means.shape
        occ, first, second, ll, n = np.zeros(n_c), np.zeros((n_c, d)), np.zeros((n_c, d)), 0.0, 0
        step = max(1, SCORED // (n_c * d))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                x = np.asarray(batch.slice(at, step).column(0).flatten(), np.float64).reshape(-1, d)
                log = mixture.score(x)
                top = log.max(1, keepdims=True)
                whole = top[:, 0] + np.log(np.exp(log - top).sum(1))
                p = np.exp(log - whole[:, None])
                occ, first, second, ll, n = occ + p.sum(0), first + p.T @ x, second + p.T @ (x * x), ll + whole.sum(), n + len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n_c, dtype=np.int32)), pa.array(occ), pa.array(first.tolist(), pa.list_(pa.float64())), pa.array(second.tolist(), pa.list_(pa.float64())), pa.array(np.full(n_c, ll)), pa.array(np.full(n_c, n))],
            ["c", "occ", "first", "second", "ll", "n"],
        )

    parts = frames.select("x").mapInArrow(partial, schema)
    per = parts.select("c", "occ", "ll", "n", F.posexplode(F.arrays_zip("first", "second")).alias("k", "z")).groupBy("c", "k").agg(F.sum("occ").alias("occ"), F.sum("z.first").alias("a"), F.sum("z.second").alias("b"), F.sum("ll").alias("ll"), F.sum("n").alias("n"))
    n_c, d = mixture.means.shape
    out = {"occ": np.zeros(n_c), "first": np.zeros((n_c, d)), "second": np.zeros((n_c, d)), "ll": np.zeros(1), "n": np.zeros(1)}
    for r in per.collect():  # components times dimensions
        out["occ"][r["c"]], out["first"][r["c"], r["k"]], out["second"][r["c"], r["k"]] = r["occ"], r["a"], r["b"]
        out["ll"][0], out["n"][0] = r["ll"], r["n"]
    return out


def em(frames: DataFrame, start: Mixture, turns: int = 10, least_occupancy: float = 10.0, least_variance: float = 1e-3) -> Mixture:
    """Expectation maximisation; components of small occupancy keep their parameters, variances and weights are floored."""
    now = start
    for _ in range(turns):
        s = em_statistics(frames, now)
        ok = s["occ"] >= least_occupancy
        occ = np.maximum(s["occ"], 1e-300)[:, None]
        mean = np.where(ok[:, None], s["first"] / occ, now.means)
        var = np.where(ok[:, None], np.maximum(s["second"] / occ - mean * mean, least_variance), now.variances)
        weight = np.maximum(s["occ"] / max(s["occ"].sum(), 1e-300), WEIGHT_FLOOR)
        now = Mixture(weight / weight.sum(), mean, var, [*now.history, float(s["ll"][0] / max(s["n"][0], 1))])
    return now


def map_adapt(frames: DataFrame, prior: Mixture, relevance: float = 16.0, parameters: str = "pmc", turns: int = 1) -> Mixture:
    """Maximum a posteriori adaptation of the named parameters: p(riors), m(eans), c(ovariances)."""
    if not parameters or set(parameters) - set("pmc"):
        raise ValueError("parameters is made of the letters p, m and c")
    now = prior
    for _ in range(turns):
        s = em_statistics(frames, now)
        share = (s["occ"] / (s["occ"] + relevance))[:, None]
        occ = np.maximum(s["occ"], 1e-300)[:, None]
        seen_mean, seen_square = s["first"] / occ, s["second"] / occ
        mean = share * seen_mean + (1 - share) * now.means if "m" in parameters else now.means
        square = share * seen_square + (1 - share) * (now.variances + now.means**2)
        var = np.maximum(square - mean**2, VARIANCE_FLOOR) if "c" in parameters else now.variances
        weight = share[:, 0] * s["occ"] / max(s["n"][0], 1) + (1 - share[:, 0]) * now.weights if "p" in parameters else now.weights
        now = Mixture(weight / weight.sum(), mean, var, [*now.history, float(s["ll"][0] / max(s["n"][0], 1))])
    return now


def _nearest_sums(frames: DataFrame, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, sums) of the frames nearest to each centroid, ties to the lowest: one partial row per task and centroid, one pass."""
    n_c, d = at.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(n_c, np.int64), np.zeros((n_c, d))
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, d)
                near = np.round(np.sqrt(((x[:, None] - at[None]) ** 2).sum(2)), 9).argmin(1)
                n += np.bincount(near, minlength=n_c)
                np.add.at(sums, near, x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_c)), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["c", "n", "x"])

    rows = frames.select("x").mapInArrow(partial, "c long, n long, x array<double>").select("c", "n", F.posexplode("x").alias("k", "v")).groupBy("c", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    n, sums = np.zeros(n_c, np.int64), np.zeros((n_c, d))
    for r in rows.collect():  # centroids times dimensions
        n[r["c"]], sums[r["c"], r["k"]] = r["n"], r["v"]
    return n, sums


def k_means(frames: DataFrame, start: np.ndarray, turns: int = 100, least_shift: float = 1e-5) -> np.ndarray:
    """Centroids after at most ``turns`` rounds or a total shift of ``least_shift``; an empty cluster splits the largest one."""
    at = np.asarray(start, float)
    for _ in range(turns):
        n, sums = _nearest_sums(frames, at)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
        if n.any():
            new[n == 0] = new[n.argmax()] * (1 + 1e-3)
        moved = float(np.abs(new - at).sum())
        at = new
        if moved <= least_shift:
            break
    return at


def lbg(frames: DataFrame, size: int, eps: float = 0.01, turns: int = 20) -> np.ndarray:
    """A codebook grown by splitting the most occupied centroid by ``1 +- eps`` and refining all."""
    at = _mean_vector(frames)[None]
    while len(at) < size:
        top = int(_nearest_sums(frames, at)[0].argmax())
        at = k_means(frames, np.concatenate([np.delete(at, top, 0), at[top : top + 1] * (1 + eps), at[top : top + 1] * (1 - eps)]), turns)
    return at


@dataclass
class Chain:
    """A hidden Markov model with discrete emissions: initial [n], transitions [n, n], emissions [n, symbols]."""

    initial: np.ndarray
    transitions: np.ndarray
    emissions: np.ndarray

    @staticmethod
    def topology(kind: str, states: int, symbols: int) -> Chain:
        """LINEAR (stay or next, first state first) or ERGODIC (all alike)."""
        if kind == "LINEAR":
            a = np.zeros((states, states))
            for i in range(states):
                a[i, i : min(i + 2, states)] = 0.5 if i + 1 < states else 1.0
            first = np.eye(states)[0]
        elif kind == "ERGODIC":
            a, first = np.full((states, states), 1 / states), np.full(states, 1 / states)
        else:
            raise ValueError(f"unknown topology {kind}")
        return Chain(first, a, np.full((states, symbols), 1 / symbols))


def joined_chains(chains: list[Chain]) -> Chain:
    """Chains one after the other: the last state of each stays or goes on to the next chain with a probability of 0.5 each."""
    n, m = sum(len(c.initial) for c in chains), max(c.emissions.shape[1] for c in chains)
    moves, emits, at = np.zeros((n, n)), np.zeros((n, m)), 0
    for c in chains:
        end = at + len(c.initial)
        moves[at:end, at:end] = c.transitions
        emits[at:end, : c.emissions.shape[1]] = c.emissions
        if at:
            moves[at - 1, at - 1 : at + 1] = 0.5
        at = end
    return Chain(np.eye(n)[0], moves, emits)


def shared_codebooks(states: DataFrame, codebooks: DataFrame, key: str) -> DataFrame:
    """``states`` with the codebook that each names; one that is missing raises. Codebooks are a model's size."""
    table = F.broadcast(codebooks.withColumn("known", F.lit(True)))
    joined = states.join(table, key, "left")
    missing = F.raise_error(F.concat(F.lit("missing codebook "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn("known", F.when(F.col("known"), True).otherwise(missing.cast("boolean"))).filter("known").drop("known")


def best_paths(chain: Chain, emitted: np.ndarray, forced: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(best states, log scores) of sequences of one length, advanced together; emitted: log densities [sequence, time, state]."""
    with np.errstate(divide="ignore"):
        a, p = np.log(chain.transitions), np.log(chain.initial)
    rows, n, _ = emitted.shape
    score, back = p + emitted[:, 0], np.zeros((n, rows, len(p)), np.int32)
    for t in range(1, n):
        each = score[:, :, None] + a
        back[t] = each.argmax(1)
        score = each.max(1) + emitted[:, t]
    q, every = np.empty((rows, n), np.int32), np.arange(rows)
    q[:, -1] = len(p) - 1 if forced else score.argmax(1)
    for t in range(n - 1, 0, -1):
        q[:, t - 1] = back[t, every, q[:, t]]
    return q, score[every, q[:, -1]]


def viterbi_rows(chain: Chain, symbols: np.ndarray, forced: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """:func:`best_paths` of sequences of symbols [sequence, time]."""
    with np.errstate(divide="ignore"):
        return best_paths(chain, np.log(chain.emissions).T[symbols], forced)


def mixture_emissions(x: np.ndarray, states: list[Mixture]) -> np.ndarray:
    """Log densities [frame, state] where each state has a mixture of its own."""
    return np.stack([np.logaddexp.reduce(m.score(x), axis=1) for m in states], axis=1)


def shared_emissions(x: np.ndarray, codebook: Mixture, weights: np.ndarray) -> np.ndarray:
    """Log densities [frame, state] where all states weigh the densities of one codebook: weights [state, component]."""
    score = codebook.score(x) - np.log(codebook.weights)
    top = score.max(1, keepdims=True)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(score - top) @ weights.T)


def decode_frames(sequences: DataFrame, chain: Chain, emit: Callable[[np.ndarray], np.ndarray], forced: bool = False) -> DataFrame:
    """rec_id, q, score of sequences of frames (rec_id, frames array<array<double>>); ``emit`` gives log densities [frame, state]."""
    kind = sequences.schema["rec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, scores = [], []
            for frames in batch.column(1).to_pylist():
                q, score = best_paths(chain, emit(np.array(frames, np.float64))[None], forced) if frames else (np.zeros((1, 0), np.int32), [0.0])
                paths.append(q[0].tolist())
                scores.append(float(score[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.list_(pa.int32())), pa.array(scores, pa.float64())], ["rec_id", "q", "score"])

    return sequences.select("rec_id", "frames").mapInArrow(run, f"rec_id {kind}, q array<int>, score double")


def viterbi(chain: Chain, symbols: np.ndarray, forced: bool = False) -> tuple[np.ndarray, float]:
    """(best states, log score) of one sequence; ``forced`` ends in the last state."""
    q, score = viterbi_rows(chain, np.asarray(symbols)[None], forced)
    return q[0], float(score[0])


def decode(sequences: DataFrame, chain: Chain, forced: bool = False) -> DataFrame:
    """rec_id, q array<int>, score of every sequence (rec_id, symbols array<int>): one row in, one out, no shuffle.

    Sequences of one length advance together, as many as keep the backpointers within about 32 MB.
    """
    kind = sequences.schema["rec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            paths, scores, by_length = [[]] * len(lists), [0.0] * len(lists), {}
            for i, s in enumerate(lists):
                if s:
                    by_length.setdefault(len(s), []).append(i)
            for n, same in by_length.items():
                step = max(1, (8 << 20) // (n * len(chain.initial)))
                for at in range(0, len(same), step):
                    some = same[at : at + step]
                    q, score = viterbi_rows(chain, np.array([lists[i] for i in some]), forced)
                    for i, path, value in zip(some, q.tolist(), score.tolist(), strict=True):
                        paths[i], scores[i] = path, value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.list_(pa.int32())), pa.array(scores, pa.float64())], ["rec_id", "q", "score"])

    return sequences.select("rec_id", "symbols").mapInArrow(run, f"rec_id {kind}, q array<int>, score double")


def boundary(mixture: Mixture, steps: int = 10_000) -> float:
    """Where the upper of two one-dimensional Gaussians becomes as likely as the lower, in steps between their means."""
    low, high = np.argsort(mixture.means[:, 0], kind="stable")[[0, -1]]
    x = mixture.means[low, 0] + (mixture.means[high, 0] - mixture.means[low, 0]) * np.arange(steps) / steps
    logs = -0.5 * (np.log(mixture.variances[:, 0])[:, None] + (x[None] - mixture.means) ** 2 / mixture.variances)
    found = np.flatnonzero(logs[high] >= logs[low])
    return float(x[found[0]]) if len(found) else float(mixture.means[high, 0])


def energy_threshold(energies: DataFrame, strategy: str = "mean") -> float:
    """The threshold between silence and speech from energies (x: arrays of one): mean, cluster, em1 or em5.

    "mean" is for representative silence. Otherwise two Gaussians are fitted, from a split at the mean along the data (k-means where a
    side has no frames), and refined by 0, 1 or 1 + 5 turns of expectation maximisation; the threshold is their boundary. Fewer than
    two energies give 0.
    """
    n, mean = energies.agg(F.count("*"), F.avg(F.element_at("x", 1))).first()
    if n < 2:
        return 0.0
    if strategy == "mean":
        return float(mean)
    turns = {"cluster": 0, "em1": 1, "em5": 6}.get(strategy)
    if turns is None:
        raise ValueError("strategy is mean, cluster, em1 or em5")
    value = F.element_at("x", 1)
    cut = mean
    if not 0 < energies.filter(value > mean).count() < n:
        at = k_means(energies, np.array([[mean * (1 - 1e-2)], [mean * (1 + 1e-2)]]))
        cut = float(at.mean())
    halves = energies.groupBy((value > cut).alias("upper")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.greatest(F.var_pop(value), F.lit(1e-3)).alias("s")).orderBy("upper").collect()
    fitted = Mixture(np.array([r["n"] / n for r in halves]), np.array([[r["m"]] for r in halves]), np.array([[r["s"]] for r in halves]))
    if len(halves) < 2:
        return float(mean)
    return boundary(em(energies, fitted, turns, least_occupancy=0.0) if turns else fitted)


def baum_welch(sequences: DataFrame, chain: Chain, turns: int = 1) -> tuple[Chain, list[float]]:
    """Re-estimated chain and the log likelihood before each turn; each task adds up its sequences' expected counts.

    Sequences that the chain cannot produce say nothing about it and are left out, of the likelihood too.
    """
    n, m = chain.emissions.shape
    lls: list[float] = []
    for _ in range(turns):
        now = chain

        def partial(batches: Iterator[pa.RecordBatch], now: Chain = now) -> Iterator[pa.RecordBatch]:
            first, moves, shown, ll = np.zeros(n), np.zeros((n, n)), np.zeros((n, m)), 0.0
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    if not s:
                        continue
                    o = np.asarray(s)
                    alpha, size = np.zeros((len(o), n)), np.zeros(len(o))
                    for t in range(len(o)):
                        alpha[t] = (now.initial if t == 0 else alpha[t - 1] @ now.transitions) * now.emissions[:, o[t]]
                        size[t] = alpha[t].sum()
                        if not size[t]:
                            break
                        alpha[t] /= size[t]
                    if not size.all():
                        continue
                    beta = np.ones((len(o), n))
                    for t in range(len(o) - 2, -1, -1):
                        beta[t] = now.transitions @ (now.emissions[:, o[t + 1]] * beta[t + 1]) / size[t + 1]
                        moves += now.transitions * np.outer(alpha[t], now.emissions[:, o[t + 1]] * beta[t + 1]) / size[t + 1]
                    gamma = alpha * beta
                    first += gamma[0]
                    np.add.at(shown.T, o, gamma)
                    ll += np.log(size).sum()
            flat = np.concatenate([first, moves.ravel(), shown.ravel(), [ll]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

        rows = sequences.select("symbols").mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        flat = np.array([r["v"] for r in rows])
        first, moves, shown = flat[:n], flat[n : n + n * n].reshape(n, n), flat[n + n * n : -1].reshape(n, m)
        lls.append(float(flat[-1]))
        share = lambda x, old: np.where(x.sum(-1, keepdims=True) > 0, x / np.maximum(x.sum(-1, keepdims=True), 1e-300), old)
        chain = Chain(share(first, now.initial), share(moves, now.transitions), share(shown, now.emissions))
    return chain, lls
