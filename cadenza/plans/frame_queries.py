"""Frame projections, filters, vector functions and sequence operators over the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import vectors as V
from cadenza.operators import sequence as S
from cadenza.plans.bindings import FRAMES, cells, frames, r6
from cadenza.plans.catalog import query

KEYS = ("rec_id", "frame_idx")


@query("prj1_selection", f"WITH {FRAMES} SELECT rec_id, frame_idx, p.pos::BIGINT AS k, round(x[p.src + 1], 6) + 0.0 AS v FROM frames, (VALUES (0,3),(1,4),(2,5),(3,0),(4,63)) p(pos, src)")
def selection(spark, sf_dir):
    return cells(frames(spark, sf_dir).withColumn("x", V.pick(F.col("x"), [3, 4, 5, 0, 63])), *KEYS)


@query(
    "prj2_projection",
    f"""WITH {FRAMES}, mean AS (SELECT k, avg(v) AS m FROM cells GROUP BY k)
SELECT rec_id, frame_idx, r AS k, round(sum((v - m) * cos((r + 1) * (c.k + 1) / 10.0)), 6) + 0.0 AS v FROM cells c JOIN mean USING (k), range(3) t(r) GROUP BY rec_id, frame_idx, r""",
)
def projection(spark, sf_dir):
    import math

    f = frames(spark, sf_dir)
    rows = [[math.cos((r + 1) * (k + 1) / 10.0) for k in range(64)] for r in range(3)]
    mean = column_means(f)
    return cells(f.crossJoin(F.broadcast(mean)).withColumn("x", V.linear(rows, V.sub(F.col("x"), F.col("mean")))), *KEYS)


def column_means(f):
    """One row: the mean vector of all frames."""
    per = f.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return per.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda c: c["m"]).alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda c: c["s"]).alias("sigma"))


@query(
    "prj4_nuisance_removal",
    f"""WITH {FRAMES}, d AS (SELECT rec_id, frame_idx, sum(v * CASE WHEN k % 2 = 0 THEN 0.125 ELSE -0.125 END) AS p FROM cells GROUP BY ALL)
SELECT rec_id, frame_idx, k, round(v - p * CASE WHEN k % 2 = 0 THEN 0.125 ELSE -0.125 END, 6) + 0.0 AS v FROM cells JOIN d USING (rec_id, frame_idx)""",
)
def nuisance_removal(spark, sf_dir):
    basis = F.lit([0.125 if k % 2 == 0 else -0.125 for k in range(64)])
    return cells(frames(spark, sf_dir).withColumn("x", V.sub(F.col("x"), V.scale(basis, V.dot(F.col("x"), basis)))), *KEYS)


@query(
    "prj7_mean_variance_normalise",
    f"""WITH {FRAMES}, s AS (SELECT k, avg(v) AS m, stddev_pop(v) AS sd FROM cells GROUP BY k)
SELECT rec_id, frame_idx, k, round((v - m) / sd, 6) + 0.0 AS v FROM cells JOIN s USING (k)""",
)
def mean_variance_normalise(spark, sf_dir):
    f = frames(spark, sf_dir)
    return cells(f.crossJoin(F.broadcast(column_means(f))).withColumn("x", V.div(V.sub(F.col("x"), F.col("mean")), F.col("sigma"))), *KEYS)


@query("prj11_column_slice", f"WITH {FRAMES} SELECT rec_id, frame_idx, k, round(v, 6) + 0.0 AS v FROM cells WHERE k < 19 AND frame_idx >= 2 AND frame_idx < 20")
def column_slice(spark, sf_dir):
    return cells(frames(spark, sf_dir).filter("frame_idx >= 2 and frame_idx < 20").withColumn("x", F.slice("x", 1, 19)), *KEYS)


@query("prj13_dc_removal", f"WITH {FRAMES}, m AS (SELECT rec_id, frame_idx, avg(v) AS m FROM cells GROUP BY ALL) SELECT rec_id, frame_idx, k, round(v - m, 6) + 0.0 AS v FROM cells JOIN m USING (rec_id, frame_idx)")
def dc_removal(spark, sf_dir):
    return cells(frames(spark, sf_dir).withColumn("x", V.shift(F.col("x"), -V.mean(F.col("x")))), *KEYS)


@query("prj15_peak_normalise", f"WITH {FRAMES}, m AS (SELECT rec_id, frame_idx, max(abs(v)) AS m FROM cells GROUP BY ALL) SELECT rec_id, frame_idx, k, round(v * 32767 / m, 4) + 0.0 AS v FROM cells JOIN m USING (rec_id, frame_idx)")
def peak_normalise(spark, sf_dir):
    peak = F.array_max(F.transform("x", F.abs))
    out = frames(spark, sf_dir).withColumn("x", V.scale(F.col("x"), F.lit(32767.0) / peak))
    return out.select(*KEYS, F.posexplode("x").alias("k", "v")).select(*KEYS, F.col("k").cast("long").alias("k"), (F.round("v", 4) + F.lit(0.0)).alias("v"))


_WINDOWS = {"hamming": (0.54, 0.46), "hann": (0.5, 0.5)}
for _name, (_a, _b) in _WINDOWS.items():

    @query(f"prj17_{_name}_weighting", f"WITH {FRAMES} SELECT rec_id, frame_idx, k, round(v * ({_a} - {_b} * cos(2 * pi() * k / 63)), 6) + 0.0 AS v FROM cells")
    def weighting(spark, sf_dir, a=_a, b=_b):
        import math

        weights = F.lit([a - b * math.cos(2 * math.pi * k / 63) for k in range(64)])
        return cells(frames(spark, sf_dir).withColumn("x", V.mul(F.col("x"), weights)), *KEYS)


@query("prj18_log_energy", f"WITH {FRAMES} SELECT rec_id, frame_idx, round(10 * log10(sum(v * v) + 0.000001), 6) AS db FROM cells GROUP BY ALL")
def log_energy(spark, sf_dir):
    from cadenza.functions.scalars import energy_to_db

    return frames(spark, sf_dir).select(*KEYS, F.round(energy_to_db(V.dot(F.col("x"), F.col("x")), 1e-6), 6).alias("db"))


@query("flt1_energy_gate", f"WITH {FRAMES} SELECT rec_id, frame_idx, round(sum(abs(v)), 6) AS energy FROM cells GROUP BY ALL HAVING sum(abs(v)) > 6.5")
def energy_gate(spark, sf_dir):
    return frames(spark, sf_dir).withColumn("energy", V.norm1(F.col("x"))).filter("energy > 6.5").select(*KEYS, F.round("energy", 6).alias("energy"))


@query("flt3_keep_class", "SELECT label, count(*) AS n FROM embeddings WHERE label = 3 OR label = 4 GROUP BY label")
def keep_class(spark, sf_dir):
    return frames(spark, sf_dir).filter(F.col("rec_id").isin(3, 4)).groupBy(F.col("rec_id").alias("label")).agg(F.count("*").alias("n"))


@query("flt7_faulty_frames", f"WITH {FRAMES} SELECT rec_id, count(*) AS n FROM (SELECT rec_id, frame_idx FROM cells GROUP BY ALL HAVING bool_and(isfinite(v))) GROUP BY rec_id")
def faulty_frames(spark, sf_dir):
    """Raises with the frame's place if a component is infinite or NaN."""
    bad = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    checked = frames(spark, sf_dir).withColumn("ok", F.when(bad, F.raise_error(F.concat(F.lit("faulty frame "), F.col("frame_idx")))).otherwise(F.lit(True)))
    return checked.filter("ok").groupBy("rec_id").agg(F.count("*").alias("n"))


_W = "OVER (PARTITION BY rec_id, k ORDER BY frame_idx)"
_WHOLE = "OVER (PARTITION BY rec_id, k ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _delta_sql(half: int) -> str:
    terms = " + ".join(f"{j} * (coalesce(lead(v, {j}) {_W}, last(v) {_WHOLE}) - coalesce(lag(v, {j}) {_W}, first(v) {_WHOLE}))" for j in range(1, half + 1))
    return f"WITH {FRAMES} SELECT rec_id, frame_idx, k, round(({terms}) / {2.0 * sum(j * j for j in range(1, half + 1))}, 6) + 0.0 AS v FROM cells"


@query("win7_delta_context3", _delta_sql(1))
def delta3(spark, sf_dir):
    return cells(S.regression_delta(frames(spark, sf_dir), 3), *KEYS)


@query("win7_delta_context5", _delta_sql(2))
def delta5(spark, sf_dir):
    return cells(S.regression_delta(frames(spark, sf_dir), 5), *KEYS)


@query(
    "win8_shifted_delta",
    f"""WITH {FRAMES}, d AS (SELECT rec_id, frame_idx, i * 64 + k AS k, lead(v, i * 3 + 2) OVER w - lead(v, i * 3) OVER w AS v FROM cells, range(7) t(i)
  WINDOW w AS (PARTITION BY rec_id, k, i ORDER BY frame_idx)), n AS (SELECT rec_id, count(*) AS n FROM frames GROUP BY rec_id)
SELECT rec_id, frame_idx, k, round(v, 6) + 0.0 AS v FROM d JOIN n USING (rec_id) WHERE frame_idx + 20 < n""",
)
def shifted_delta(spark, sf_dir):
    return cells(S.shifted_delta(frames(spark, sf_dir)), *KEYS)


@query(
    "win9_trajectories",
    f"""WITH {FRAMES}, n AS (SELECT rec_id, count(*) AS n FROM frames GROUP BY rec_id)
SELECT c.rec_id, c.frame_idx - j AS frame_idx, c.k * 5 + j AS k, round(v, 6) + 0.0 AS v FROM cells c JOIN n USING (rec_id), range(5) t(j) WHERE c.frame_idx - j >= 0 AND c.frame_idx - j + 4 < n""",
)
def trajectories(spark, sf_dir):
    return cells(S.trajectories(frames(spark, sf_dir), 5), *KEYS)


@query("lim2_first_local_maxima", f"""WITH {FRAMES}, m AS (SELECT rec_id, frame_idx, k, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM cells WINDOW w AS (PARTITION BY rec_id, frame_idx ORDER BY k)),
r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, frame_idx ORDER BY k) AS n FROM m WHERE a <= v AND v >= b)
SELECT rec_id, frame_idx, n - 1 AS place, k AS at FROM r WHERE n <= 3""")
def first_local_maxima(spark, sf_dir):
    found = frames(spark, sf_dir).select(*KEYS, F.posexplode(F.slice(S.local_maxima(F.col("x")), 1, 3)).alias("place", "at"))
    return found.select(*KEYS, F.col("place").cast("long").alias("place"), F.col("at").cast("long").alias("at"))


@query("lim3_best_candidates", f"""WITH {FRAMES}, r AS (SELECT rec_id, frame_idx, k, v, row_number() OVER (PARTITION BY rec_id, frame_idx ORDER BY v DESC, k DESC) AS n FROM cells)
SELECT rec_id, frame_idx, 3 - n AS place, k AS at, round(v, 6) + 0.0 AS v FROM r WHERE n <= 3""")
def best_candidates(spark, sf_dir):
    """The three largest components, ascending: the best is last."""
    pairs = F.transform("x", lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    best = frames(spark, sf_dir).select(*KEYS, F.posexplode(F.slice(F.array_sort(pairs), -3, 3)).alias("place", "c"))
    return best.select(*KEYS, F.col("place").cast("long").alias("place"), F.col("c.i").cast("long").alias("at"), r6(F.col("c.v")).alias("v"))


@query("lim5_prefix", f"WITH {FRAMES} SELECT rec_id, count(*) AS n FROM frames WHERE frame_idx < 30 GROUP BY rec_id")
def prefix(spark, sf_dir):
    return frames(spark, sf_dir).filter("frame_idx < 30").groupBy("rec_id").agg(F.count("*").alias("n"))


@query("set2_union_frames", f"WITH {FRAMES} SELECT rec_id, count(*) AS n FROM (SELECT * FROM frames WHERE rec_id < 3 UNION ALL SELECT * FROM frames WHERE rec_id < 5) GROUP BY rec_id")
def union_frames(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.filter("rec_id < 3").unionByName(f.filter("rec_id < 5")).groupBy("rec_id").agg(F.count("*").alias("n"))


# Distances between mean vectors of records (each record against each other: a few rows a side).
_PAIRS = f"""WITH {FRAMES}, means AS (SELECT rec_id, k, avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY ALL),
p AS (SELECT a.rec_id AS a, b.rec_id AS b, a.m AS x, b.m AS y, a.s AS sx, b.s AS sy FROM means a JOIN means b ON a.k = b.k AND a.rec_id < b.rec_id)"""


def _record_pairs(spark, sf_dir):
    f = frames(spark, sf_dir)
    per = f.select("rec_id", F.posexplode("x").alias("k", "v")).groupBy("rec_id", "k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    vec = per.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("c"))
    vec = vec.select("rec_id", F.transform("c", lambda c: c["m"]).alias("m"), F.transform("c", lambda c: c["s"]).alias("s"))
    a = vec.select(F.col("rec_id").alias("a"), F.col("m").alias("x"), F.col("s").alias("sx"))
    b = vec.select(F.col("rec_id").alias("b"), F.col("m").alias("y"), F.col("s").alias("sy"))
    return a.join(b, F.col("a") < F.col("b"))


def _pair_query(name, sql, column):
    @query(name, f"{_PAIRS} SELECT a, b, round({sql}, 6) AS d FROM p GROUP BY a, b")
    def run(spark, sf_dir):
        return _record_pairs(spark, sf_dir).select("a", "b", F.round(column(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")), 6).alias("d"))

    return run


_pair_query("scl1_cosine_angle", "degrees(acos(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))))", lambda x, y, sx, sy: V.angle(x, y))
_pair_query("scl2_normalised_cosine", "degrees(acos(sum(x / sx * y / sy) / (sqrt(sum((x / sx) ** 2)) * sqrt(sum((y / sy) ** 2)))))", lambda x, y, sx, sy: V.angle(V.div(x, sx), V.div(y, sy)))
_pair_query(
    "scl3_kullback_leibler",
    "(sum(sx / sy + sy / sx) - 64 + sum((x - y) ** 2 * (1 / sx + 1 / sy))) / 100000",
    lambda x, y, sx, sy: (V.total(V.add(V.div(sx, sy), V.div(sy, sx))) - 64.0 + V.dot(V.mul(V.sub(x, y), V.sub(x, y)), F.zip_with(sx, sy, lambda p, q: 1 / p + 1 / q))) / 100000.0,
)
_pair_query(
    "scl4_bhattacharyya",
    "sum((x - y) ** 2 / ((sx + sy) / 2)) / 8 + 0.5 * sum(ln((sx + sy) / 2)) - 0.25 * (sum(ln(sx)) + sum(ln(sy)))",
    lambda x, y, sx, sy: V.total(V.div(V.mul(V.sub(x, y), V.sub(x, y)), V.scale(V.add(sx, sy), 0.5))) / 8.0
    + 0.5 * V.total(F.zip_with(sx, sy, lambda p, q: F.log((p + q) / 2.0)))
    - 0.25 * (V.total(F.transform(sx, lambda p: F.log(p))) + V.total(F.transform(sy, lambda p: F.log(p)))),
)
_pair_query("scl5_euclidean", "sqrt(sum((x - y) ** 2))", lambda x, y, sx, sy: V.euclidean(x, y))
_pair_query("scl5_manhattan", "sum(abs(x - y))", lambda x, y, sx, sy: V.manhattan(x, y))
_pair_query("scl7_dot_product", "sum(x * y)", lambda x, y, sx, sy: V.dot(x, y))
_pair_query("scl7_norm_of_sum", "sqrt(sum((x + 0.5 * y) ** 2))", lambda x, y, sx, sy: V.norm2_of_sum(x, y, 0.5))
_pair_query("scl8_vector_sum", "sum(abs(x + y)) + sum(abs(x - 2 * y))", lambda x, y, sx, sy: V.norm1(V.add(x, y)) + V.norm1(V.sub(x, V.scale(y, 2.0))))
_pair_query("scl9_component_products", "sum(x * y / sx) + sum(x / sy * 3)", lambda x, y, sx, sy: V.total(V.div(V.mul(x, y), sx)) + V.total(V.scale(V.div(x, sy), 3.0)))
_pair_query("scl11_interpolation", "sqrt(sum((0.7 * x + 0.3 * y) ** 2))", lambda x, y, sx, sy: V.norm2(V.interpolate(x, y, 0.3)))
_pair_query("jn9_kernel_matrix", "sum(x * y) / 64", lambda x, y, sx, sy: V.dot(x, y) / 64.0)


@query("scl10_outer_product_trace", f"WITH {FRAMES} SELECT rec_id, frame_idx, round(sum(v * v), 6) AS trace, round(sum(v) ** 2, 6) AS all_cells FROM cells WHERE k < 8 GROUP BY ALL")
def outer_product(spark, sf_dir):
    return _outer_product(frames(spark, sf_dir), F.slice("x", 1, 8))


@query("scl10_outer_product_trace_whole", f"WITH {FRAMES} SELECT rec_id, frame_idx, round(sum(v * v), 6) AS trace, round(sum(v) ** 2, 6) AS all_cells FROM cells GROUP BY ALL")
def outer_product_whole(spark, sf_dir):
    """As above, of whole vectors."""
    return _outer_product(frames(spark, sf_dir), F.col("x"))


def _outer_product(table, x):
    m = V.outer(x, x)
    trace = V.total(F.transform(m, lambda r, i: F.element_at(r, (i + 1).cast("int"))))
    return table.select(*KEYS, F.round(trace, 6).alias("trace"), F.round(V.total(F.flatten(m)), 6).alias("all_cells"))


_DCT = f"""WITH {FRAMES} SELECT rec_id, frame_idx, j AS k, round(sum(v * cos(pi() * (k + 0.5) * j / 64)) * CASE WHEN j = 0 THEN sqrt(1.0 / 64) ELSE sqrt(2.0 / 64) END, 6) + 0.0 AS v
FROM cells, range(8) t(j) GROUP BY rec_id, frame_idx, j"""


def _dct(spark, sf_dir, n):
    from cadenza.operators.spectral import dct_basis

    return cells(frames(spark, sf_dir).withColumn("x", V.linear(dct_basis(64, n).tolist(), F.col("x"))), *KEYS)


@query("sig9_dct", _DCT)
def dct(spark, sf_dir):
    return _dct(spark, sf_dir, 8)


@query("sig9_dct_whole", _DCT.replace("range(8)", "range(64)"))
def dct_whole(spark, sf_dir):
    return _dct(spark, sf_dir, 64)


@query("sig10_hartley", f"""WITH {FRAMES} SELECT rec_id, frame_idx, j AS k, round(sum(v * (cos(2 * pi() * k * j / 64) + sin(2 * pi() * k * j / 64))), 6) + 0.0 AS v FROM cells, range(64) t(j) GROUP BY rec_id, frame_idx, j""")
def hartley(spark, sf_dir):
    from cadenza.operators.spectral import hartley_transform

    return cells(frames(spark, sf_dir).withColumn("x", hartley_transform(F.col("x"))), *KEYS)


_ACF = f"""WITH {FRAMES} SELECT a.rec_id, a.frame_idx, j AS k, round(sum(a.v * b.v), 6) + 0.0 AS v FROM cells a, range(8) t(j), cells b
WHERE b.rec_id = a.rec_id AND b.frame_idx = a.frame_idx AND b.k = (a.k + j) % 64 GROUP BY a.rec_id, a.frame_idx, j"""


def _acf(spark, sf_dir, lags):
    turned = lambda j: V.dot(F.col("x"), F.concat(F.slice("x", j + 1, F.size("x")), F.slice("x", F.lit(1), j)))
    return cells(frames(spark, sf_dir).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), turned)), *KEYS)


@query("sig11_circular_acf", _ACF)
def circular_acf(spark, sf_dir):
    return _acf(spark, sf_dir, 8)


@query("sig11_circular_acf_whole", _ACF.replace("range(8)", "range(64)"))
def circular_acf_whole(spark, sf_dir):
    return _acf(spark, sf_dir, 64)


@query("jn5_nearest_centroid", f"""WITH {FRAMES}, cen AS (SELECT rec_id AS c, k, avg(v) AS m FROM cells GROUP BY ALL),
d AS (SELECT f.rec_id, f.frame_idx, c, round(sqrt(sum((v - m) ** 2)), 9) AS d FROM cells f JOIN cen USING (k) GROUP BY f.rec_id, f.frame_idx, c)
SELECT rec_id, frame_idx, arg_min(c, d) AS nearest, round(min(d), 6) AS far FROM d GROUP BY ALL""")
def nearest_centroid(spark, sf_dir):
    from cadenza.operators.models import assign, class_means

    f = frames(spark, sf_dir)
    out = assign(f, class_means(f, "rec_id"))
    return out.select(*KEYS, F.col("cluster").alias("nearest"), F.round("far", 6).alias("far"))


@query("agg1_column_mean", f"WITH {FRAMES} SELECT rec_id, k, round(avg(v), 6) + 0.0 AS v FROM cells GROUP BY ALL")
def column_mean(spark, sf_dir):
    return frames(spark, sf_dir).select("rec_id", F.posexplode("x").alias("k", "v")).groupBy("rec_id", F.col("k").cast("long").alias("k")).agg(r6(F.avg("v")).alias("v"))


@query("agg5_column_deviation", f"WITH {FRAMES} SELECT rec_id, k, round(stddev_pop(v), 6) AS sd, round(var_pop(v), 6) AS var FROM cells GROUP BY ALL")
def column_deviation(spark, sf_dir):
    """Population deviations and variances by column."""
    return frames(spark, sf_dir).select("rec_id", F.posexplode("x").alias("k", "v")).groupBy("rec_id", F.col("k").cast("long").alias("k")).agg(F.round(F.stddev_pop("v"), 6).alias("sd"), F.round(F.var_pop("v"), 6).alias("var"))


@query("agg6_full_gaussian", f"""WITH {FRAMES}, m AS (SELECT k, avg(v) AS m FROM cells GROUP BY k), c AS (SELECT rec_id, frame_idx, k, v - m AS v FROM cells JOIN m USING (k) WHERE k < 6)
SELECT a.k AS i, b.k AS j, round(avg(a.v * b.v), 6) + 0.0 AS cov FROM c a JOIN c b USING (rec_id, frame_idx) WHERE b.k <= a.k GROUP BY a.k, b.k""")
def full_gaussian(spark, sf_dir):
    return _full_gaussian(frames(spark, sf_dir).withColumn("x", F.slice("x", 1, 6)))


@query("agg6_full_gaussian_whole", f"""WITH {FRAMES}, m AS (SELECT k, avg(v) AS m FROM cells GROUP BY k), c AS (SELECT rec_id, frame_idx, k, v - m AS v FROM cells JOIN m USING (k))
SELECT a.k AS i, b.k AS j, round(avg(a.v * b.v), 6) + 0.0 AS cov FROM c a JOIN c b USING (rec_id, frame_idx) WHERE b.k <= a.k GROUP BY a.k, b.k""")
def full_gaussian_whole(spark, sf_dir):
    """As above, of whole vectors."""
    return _full_gaussian(frames(spark, sf_dir))


def _full_gaussian(table):
    from cadenza.operators.models import full_covariance

    cov = full_covariance(table)
    return cov.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6(F.col("cov")).alias("cov"))


@query("agg11_class_statistics", f"WITH {FRAMES}, n AS (SELECT rec_id, count(*) AS n, count(*) / (SELECT count(*) FROM frames)::DOUBLE AS p FROM frames GROUP BY rec_id) SELECT rec_id, n, round(p, 6) AS prior FROM n")
def class_statistics(spark, sf_dir):
    f = frames(spark, sf_dir)
    total = f.agg(F.count("*").alias("t"))
    return f.groupBy("rec_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("rec_id", "n", F.round(F.col("n") / F.col("t"), 6).alias("prior"))


@query("agg12_mean_subtract", f"WITH {FRAMES}, m AS (SELECT k, avg(v) AS m FROM cells GROUP BY k) SELECT rec_id, frame_idx, k, round(v - m, 6) + 0.0 AS v FROM cells JOIN m USING (k)")
def mean_subtract(spark, sf_dir):
    f = frames(spark, sf_dir)
    return cells(f.crossJoin(F.broadcast(column_means(f))).withColumn("x", V.sub(F.col("x"), F.col("mean"))), *KEYS)


@query("agg20_vector_extremes", f"WITH {FRAMES} SELECT rec_id, frame_idx, round(min(v), 6) + 0.0 AS low, round(max(v), 6) + 0.0 AS high FROM cells GROUP BY ALL")
def vector_extremes(spark, sf_dir):
    return frames(spark, sf_dir).select(*KEYS, r6(F.array_min("x")).alias("low"), r6(F.array_max("x")).alias("high"))


@query("agg21_sum_to_one", f"WITH {FRAMES}, s AS (SELECT rec_id, frame_idx, sum(abs(v)) AS s FROM cells GROUP BY ALL) SELECT rec_id, frame_idx, k, round(abs(v) / s, 6) AS v FROM cells JOIN s USING (rec_id, frame_idx)")
def sum_to_one(spark, sf_dir):
    return cells(frames(spark, sf_dir).withColumn("x", V.sum_to_one(F.transform("x", F.abs))), *KEYS)


@query("snk16_three_decimals", f"WITH {FRAMES} SELECT rec_id, frame_idx, k, floor(v * 1000 + 0.5) / 1000 + 0.0 AS v FROM cells")
def three_decimals(spark, sf_dir):
    from cadenza.functions.scalars import round_half_up

    return cells(frames(spark, sf_dir).withColumn("x", F.transform("x", lambda v: round_half_up(v))), *KEYS)


@query("sta1_diagonal_scores", f"""WITH {FRAMES}, g AS (SELECT rec_id AS c, k, avg(v) AS m, greatest(var_pop(v), 1e-10) AS s FROM cells GROUP BY ALL)
SELECT f.rec_id, f.frame_idx, c, round(-0.5 * sum(ln(2 * pi() * s) + (v - m) ** 2 / s), 5) AS score FROM cells f JOIN g USING (k) GROUP BY f.rec_id, f.frame_idx, c""")
def diagonal_scores(spark, sf_dir):
    from cadenza.operators.models import class_gaussians, log_densities

    f = frames(spark, sf_dir)
    scored = log_densities(f, class_gaussians(f, "rec_id"))
    return scored.select(*KEYS, F.posexplode("scores").alias("i", "s")).select(*KEYS, F.col("s.id").alias("c"), F.round("s.score", 5).alias("score"))


@query("sta5_posteriors", f"""WITH {FRAMES}, g AS (SELECT rec_id AS c, k, avg(v) AS m, greatest(var_pop(v), 1e-10) AS s FROM cells GROUP BY ALL), n AS (SELECT rec_id AS c, count(*) / (SELECT count(*) FROM frames)::DOUBLE AS p FROM frames GROUP BY ALL),
l AS (SELECT f.rec_id, f.frame_idx, c, ln(p) - 0.5 * sum(ln(2 * pi() * s) + (v - m) ** 2 / s) AS l FROM cells f JOIN g USING (k) JOIN n USING (c) GROUP BY f.rec_id, f.frame_idx, c, p),
z AS (SELECT rec_id, frame_idx, max(l) AS top, max(l) + ln(sum(exp(l - m2))) AS z FROM (SELECT *, max(l) OVER (PARTITION BY rec_id, frame_idx) AS m2 FROM l) GROUP BY rec_id, frame_idx)
SELECT rec_id, frame_idx, c, round(exp(l - z), 6) AS p, round(z, 5) AS score FROM l JOIN z USING (rec_id, frame_idx)""")
def posteriors(spark, sf_dir):
    from cadenza.operators.models import class_gaussians, log_densities, mixture_posteriors

    f = frames(spark, sf_dir)
    scored = mixture_posteriors(log_densities(f, class_gaussians(f, "rec_id")))
    return scored.select(*KEYS, F.round("score", 5).alias("score"), F.explode("posteriors").alias("q")).select(*KEYS, F.col("q.id").alias("c"), F.round("q.p", 6).alias("p"), "score")


@query("lim4_classify", f"""WITH {FRAMES}, g AS (SELECT rec_id AS c, k, avg(v) AS m, greatest(var_pop(v), 1e-10) AS s FROM cells GROUP BY ALL),
l AS (SELECT f.rec_id, f.frame_idx, c, -0.5 * sum(ln(2 * pi() * s) + (v - m) ** 2 / s) AS l FROM cells f JOIN g USING (k) GROUP BY f.rec_id, f.frame_idx, c)
SELECT rec_id, frame_idx, arg_max(c, l) AS y FROM l GROUP BY ALL""")
def classify(spark, sf_dir):
    """The component of the largest density, without priors."""
    from cadenza.operators.models import class_gaussians, log_densities

    f = frames(spark, sf_dir)
    best = F.array_max(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["id"]).alias("id"))))
    return log_densities(f, class_gaussians(f, "rec_id")).select(*KEYS, (-best["id"]).alias("y"))


@query("sta12_fast_init", f"""WITH {FRAMES}, o AS (SELECT *, ((row_number() OVER (ORDER BY rec_id, frame_idx) - 1) // 25) % 4 AS c FROM frames), u AS (SELECT c, unnest(range(len(x))) AS k, unnest(x) AS v FROM o)
SELECT c, k, round(avg(v), 6) + 0.0 AS m, round(var_pop(v), 6) AS s FROM u GROUP BY ALL""")
def fast_init(spark, sf_dir):
    """Blocks of 25 frames dealt in turn to 4 components, each estimated by maximum likelihood."""
    f = frames(spark, sf_dir)
    before = f.groupBy("rec_id").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("rec_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("before") + F.col("frame_idx")
    dealt = f.join(before, "rec_id").withColumn("c", F.floor(place / 25) % 4)
    return dealt.select("c", F.posexplode("x").alias("k", "v")).groupBy("c", F.col("k").cast("long").alias("k")).agg(r6(F.avg("v")).alias("m"), F.round(F.var_pop("v"), 6).alias("s"))
