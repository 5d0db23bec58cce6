"""Marginals, supervectors, densities, boundaries and splitting clusterings over the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions import vectors as V
from cadenza.functions.shared import rewritten
from cadenza.operators import accumulators as A
from cadenza.operators import clustering as G
from cadenza.operators import models as M
from cadenza.plans.bindings import FRAMES, cells, frames, r6
from cadenza.plans.catalog import query, table

KEYS = ("rec_id", "frame_idx")
_CLASSES = "g AS (SELECT rec_id AS c, k, avg(v) AS m, greatest(var_pop(v), 1e-10) AS s, count(*) AS n FROM cells GROUP BY ALL)"


@query("prj3_projection_in_place", f"""WITH {FRAMES}, mean AS (SELECT k, avg(v) AS m FROM cells GROUP BY k), y AS (SELECT rec_id, frame_idx, r, sum((v - m) * sin((r + 2) * (c.k + 1) / 7.0)) AS y FROM cells c JOIN mean USING (k), range(3) t(r) GROUP BY ALL)
SELECT rec_id, frame_idx, k, round(CASE WHEN k < 3 THEN v + y ELSE 0 END, 6) + 0.0 AS v FROM cells LEFT JOIN y USING (rec_id, frame_idx) WHERE (k < 3 AND r = k) OR (k >= 3 AND r = 0)""")
def projection_in_place(spark, sf_dir):
    f = frames(spark, sf_dir)
    rows = np.array([[np.sin((r + 2) * (k + 1) / 7.0) for k in range(64)] for r in range(3)])
    p = M.Projection(M._mean_vector(f), rows, np.ones(3))
    return cells(p.add_to(f, 3), *KEYS)


@query("prj5_blockwise_nuisance", f"""WITH {FRAMES}, d AS (SELECT rec_id, frame_idx, k // 16 AS b, sum(v * 0.25) AS p FROM cells GROUP BY ALL)
SELECT rec_id, frame_idx, k, round(v - 0.25 * p, 6) + 0.0 AS v FROM cells JOIN d USING (rec_id, frame_idx) WHERE d.b = k // 16""")
def blockwise_nuisance(spark, sf_dir):
    return cells(G.remove_nuisance(frames(spark, sf_dir), np.full((1, 16), 0.25), blocks=4), *KEYS)


@query("prj6_sta21_nuisance_training")
def nuisance_training(spark, sf_dir):
    """Frames without the two leading directions within the classes."""
    f = frames(spark, sf_dir)
    return cells(G.remove_nuisance(f, G.nuisance_basis(f, "rec_id", 2)), *KEYS)


@query("prj8_marginal_gaussians", f"WITH {FRAMES}, {_CLASSES} SELECT c, k - 5 AS k, round(m, 6) + 0.0 AS m, round(s, 6) AS s FROM g WHERE k BETWEEN 5 AND 14")
def marginal_gaussians(spark, sf_dir):
    """The classes' Gaussians over the interval of dimensions 5 to 14."""
    g = M.class_gaussians(frames(spark, sf_dir), "rec_id")
    kept = g.select(F.col("id").alias("c"), F.posexplode(F.arrays_zip(F.filter("m", lambda v, i: (i >= 5) & (i <= 14)).alias("m"), F.filter("s", lambda v, i: (i >= 5) & (i <= 14)).alias("s"))).alias("k", "z"))
    return kept.select("c", F.col("k").cast("long").alias("k"), r6(F.col("z.m")).alias("m"), F.round("z.s", 6).alias("s"))


@query("prj9_supervector", f"""WITH {FRAMES}, {_CLASSES}, t AS (SELECT count(*) AS t FROM frames), o AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS p FROM (SELECT DISTINCT c FROM g))
SELECT p * 129 AS i, round(max(n) / max(t)::DOUBLE, 6) AS v FROM g JOIN o USING (c), t GROUP BY p
UNION ALL SELECT p * 129 + 1 + k, round(m, 6) + 0.0 FROM g JOIN o USING (c) UNION ALL SELECT p * 129 + 65 + k, round(s, 6) FROM g JOIN o USING (c)""")
def supervector(spark, sf_dir):
    """Prior, mean and variance of each component, one after the other."""
    g = M.class_gaussians(frames(spark, sf_dir), "rec_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("id", "weight", "m", "s"))), lambda c: F.concat(F.array(c["weight"]), c["m"], c["s"]))
    return g.agg(F.flatten(parts).alias("x")).select(F.posexplode("x").alias("i", "v")).select(F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


@query("prj10_full_to_diagonal", f"WITH {FRAMES} SELECT k, round(var_pop(v), 6) AS var FROM cells WHERE k < 6 GROUP BY k")
def full_to_diagonal(spark, sf_dir):
    """The diagonal of a packed full covariance: places i (i + 3) / 2."""
    return _packed_diagonal(frames(spark, sf_dir).withColumn("x", F.slice("x", 1, 6)), 6)


@query("prj10_full_to_diagonal_whole", f"WITH {FRAMES} SELECT k, round(var_pop(v), 6) AS var FROM cells GROUP BY k")
def full_to_diagonal_whole(spark, sf_dir):
    """As above, of whole vectors."""
    return _packed_diagonal(frames(spark, sf_dir), 64)


def _packed_diagonal(table, size):
    cov = M.full_covariance(table)
    packed = cov.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))), lambda c: c["cov"]).alias("x"))
    diagonal = packed.select(F.posexplode(V.pick(F.col("x"), [i * (i + 3) // 2 for i in range(size)])).alias("k", "var"))
    return diagonal.select(F.col("k").cast("long").alias("k"), F.round("var", 6).alias("var"))


@query("scl6_supervector_distance", f"""WITH {FRAMES}, {_CLASSES}, u AS (SELECT k, var_pop(v) AS s FROM cells GROUP BY k)
SELECT a.c AS a, b.c AS b, round(sqrt(0.5 * sum((a.m - b.m) ** 2 / u.s)), 6) AS distance, round(sum(a.m * b.m / u.s), 6) + 0.0 AS kernel FROM g a JOIN g b USING (k) JOIN u USING (k) WHERE a.c < b.c GROUP BY a.c, b.c""")
def supervector_distance(spark, sf_dir):
    """Distance and kernel of mean supervectors, scaled by a background model of one component."""
    f = frames(spark, sf_dir)
    m = M.class_means(f, "rec_id")
    u = M.class_gaussians(f.withColumn("rec_id", F.lit(0)), "rec_id").select(F.col("s").alias("u"))
    pairs = m.select(F.col("id").alias("a"), F.col("m").alias("x")).join(m.select(F.col("id").alias("b"), F.col("m").alias("y")), F.col("a") < F.col("b")).crossJoin(F.broadcast(u))
    d = V.sub(F.col("x"), F.col("y"))
    return pairs.select("a", "b", F.round(F.sqrt(0.5 * V.total(V.div(V.mul(d, d), F.col("u")))), 6).alias("distance"), r6(V.total(V.div(V.mul(F.col("x"), F.col("y")), F.col("u")))).alias("kernel"))


@query("agg23_average_log_likelihood", f"""WITH {FRAMES}, {_CLASSES}, l AS (SELECT f.rec_id, f.frame_idx, c, ln(max(n) / (SELECT count(*) FROM frames)::DOUBLE) - 0.5 * sum(ln(2 * pi() * s) + (v - m) ** 2 / s) AS l FROM cells f JOIN g USING (k) GROUP BY f.rec_id, f.frame_idx, c),
t AS (SELECT *, max(l) OVER (PARTITION BY rec_id, frame_idx) AS top FROM l), z AS (SELECT rec_id, frame_idx, any_value(top) + ln(sum(exp(l - top))) AS z FROM t GROUP BY ALL) SELECT rec_id, count(*) AS n, round(avg(z), 4) AS ll FROM z GROUP BY rec_id""")
def average_log_likelihood(spark, sf_dir):
    f = frames(spark, sf_dir)
    scored = M.mixture_posteriors(M.log_densities(f, M.class_gaussians(f, "rec_id")))
    return scored.groupBy("rec_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("ll"))


@query("sig19_decision_boundary", f"""WITH {FRAMES}, g AS (SELECT rec_id AS c, avg(v) AS m, stddev_pop(v) AS s FROM cells WHERE k = 0 AND rec_id IN (1, 2) GROUP BY rec_id),
p AS (SELECT min(m) AS a, max(m) AS b, arg_min(s, m) AS sa, arg_max(s, m) AS sb FROM g), x AS (SELECT a + (b - a) * i / 10000.0 AS x, a, b, sa, sb FROM p, range(10000) t(i))
SELECT round(min(x), 6) + 0.0 AS boundary FROM x WHERE -ln(sb) - (x - b) ** 2 / (2 * sb * sb) >= -ln(sa) - (x - a) ** 2 / (2 * sa * sa)""")
def decision_boundary(spark, sf_dir):
    """The first of 10,000 steps between the means of two Gaussians where the upper one is as likely."""
    g = frames(spark, sf_dir).filter("rec_id in (1, 2)").groupBy("rec_id").agg(F.avg(F.element_at("x", 1)).alias("m"), F.stddev_pop(F.element_at("x", 1)).alias("s"))
    p = g.agg(F.min("m").alias("a"), F.max("m").alias("b"), F.min_by("s", "m").alias("sa"), F.max_by("s", "m").alias("sb"))
    x = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(9999))).alias("i")).withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / 10000.0)

    def log(m, s):
        return -F.log(F.col(s)) - (F.col("x") - F.col(m)) * (F.col("x") - F.col(m)) / (2 * F.col(s) * F.col(s))

    return x.filter(log("b", "sb") >= log("a", "sa")).agg(r6(F.min("x")).alias("boundary"))


@query("sta2_full_gaussian_scores")
def full_gaussian_scores(spark, sf_dir):
    """Log density of each frame under the full Gaussian of all."""
    f = frames(spark, sf_dir)
    cov = M.covariance_matrix(f)
    precision, half = np.linalg.inv(cov), -0.5 * (np.linalg.slogdet(cov)[1] + len(cov) * np.log(2 * np.pi))
    d = V.sub(F.col("x"), F.lit(M._mean_vector(f).tolist()))
    return f.select(*KEYS, F.round(F.lit(float(half)) - 0.5 * V.dot(d, V.linear(precision.tolist(), d)), 6).alias("score"))


@query("agg8_kept_accumulator", f"""WITH {FRAMES.replace('FROM embeddings)', 'FROM embeddings WHERE vec_id % 3 <> 0)', 1)}
SELECT rec_id, k, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v), 6) + 0.0 AS var FROM cells GROUP BY rec_id, k""")
def kept_accumulator(spark, sf_dir):
    """Statistics of two parts, kept as tables and added; then one part is taken away again."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("rec_id"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    a, b = (rewritten(A.statistics(rows.filter(which)), "statistics") for which in ("vec_id % 3 = 0", "vec_id % 3 <> 0"))
    left = A.without(rewritten(A.merged(a, b), "statistics"), a)
    squares = F.transform("s", lambda v, i: F.element_at("q", ((i + 1) * (i + 2) / 2).cast("int")))
    cells_ = left.select("rec_id", "n", F.posexplode(F.arrays_zip("s", squares.alias("q"))).alias("k", "c"))
    mean = F.col("c.s") / F.col("n")
    return cells_.select("rec_id", F.col("k").cast("long").alias("k"), "n", r6(mean).alias("mean"), r6(F.col("c.q") / F.col("n") - mean * mean).alias("var"))


@query("sta2_full_gaussians_by_class")
def full_gaussians_by_class(spark, sf_dir):
    """The best of full Gaussians of each class and its log density; class 0 loses a component, so its covariance has no inverse."""
    x = F.when(F.col("rec_id") == 0, F.transform("x", lambda v, i: F.when(i == 0, 0.0).otherwise(v))).otherwise(F.col("x"))
    f = frames(spark, sf_dir).withColumn("x", x)
    scored = A.full_scores(f, A.FullGaussians.of(A.statistics(f)))
    return scored.select(*KEYS, (F.array_position("scores", F.array_max("scores")) - 1).alias("best"), F.round(F.array_max("scores"), 6).alias("score"))


@query("sta10_g_means")
def g_means(spark, sf_dir):
    at = G.g_means(frames(spark, sf_dir), 0.0001, most=4)
    return spark.createDataFrame([(i, k, float(v)) for i, m in enumerate(at) for k, v in enumerate(m)], "c int, k int, v double")


@query("sta11_hierarchical_clusters")
def hierarchical_clusters(spark, sf_dir):
    return G.hierarchical(frames(spark, sf_dir), 4).select(*KEYS, "cluster")


@query("sta17_mmie")
def mmie(spark, sf_dir):
    """All classes, each with two components (of its even and odd frames), updated by segments of 4 frames."""
    f = frames(spark, sf_dir).filter("rec_id is not null")
    dealt = f.withColumn("one", F.struct("rec_id", (F.col("frame_idx") % 2).alias("j")))
    by = {}
    for r in M.class_gaussians(dealt, "one").orderBy("id").collect():
        by.setdefault(r["id"]["rec_id"], []).append(r)
    by = {c: g * (2 // len(g)) for c, g in by.items()}  # a class of one frame has its component twice
    start = [M.Mixture(w / w.sum(), np.array([r["m"] for r in g]), np.array([r["s"] for r in g])) for g in by.values() for w in [np.array([r["weight"] for r in g])]]
    placed = f.withColumn("c", F.array_position(F.lit(list(by)), F.col("rec_id")) - 1).withColumn("seg_id", F.floor(F.col("frame_idx") / 4))
    new = G.mmie(placed, start, "c", segment=["seg_id"])
    rows = [(c, j, k, float(m.weights[j]), float(m.means[j, k]), float(m.variances[j, k])) for c, m in zip(by, new, strict=True) for j in range(2) for k in range(64)]
    return spark.createDataFrame(rows, "c int, j int, k int, weight double, mean double, var double")


@query("sta19_sparse_components")
def sparse_components(spark, sf_dir):
    _, values = G.sparse_pca(frames(spark, sf_dir), 5)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, value double")


@query("sta6_drawn_samples")
def drawn_samples(spark, sf_dir):
    """A sample for every frame from its class's Gaussian, from a fixed seed."""
    f = frames(spark, sf_dir)
    g = M.class_gaussians(f, "rec_id").withColumnRenamed("id", "rec_id")
    drawn = f.select(*KEYS).join(g, "rec_id").withColumn("u", F.xxhash64(*KEYS, F.lit(7)))
    uniform = F.shiftrightunsigned(F.xxhash64("u", "i"), 11) / F.lit(float(1 << 53))
    other = F.shiftrightunsigned(F.xxhash64("u", "i", F.lit(1)), 11) / F.lit(float(1 << 53))
    normal = F.sqrt(-2 * F.log(F.greatest(uniform, F.lit(1e-300)))) * F.cos(2 * np.pi * other)
    each = drawn.select(*KEYS, "u", F.posexplode(F.arrays_zip("m", "s")).alias("i", "z"))
    return each.select(*KEYS, F.col("i").cast("long").alias("k"), (F.col("z.m") + normal * F.sqrt(F.col("z.s"))).alias("v"))
