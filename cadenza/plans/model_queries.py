"""Modelling, spectral, source and stream queries; iterative ones have no SQL and are tested against plain numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cadenza import streaming
from cadenza.operators import chains as H
from cadenza.operators import models as M
from cadenza.operators import sequence as S
from cadenza.operators import spectral
from cadenza.plans.bindings import FRAMES, SAMPLES, cells, frames, r6, samples
from cadenza.plans.catalog import query, table

SYMBOLS = ["cart", "click", "error", "login", "logout", "purchase", "search", "signup", "view"]


def _start(spark, sf_dir) -> M.Mixture:
    """Classes 0 to 3 as a start."""
    rows = M.class_gaussians(frames(spark, sf_dir).filter("rec_id < 4"), "rec_id").orderBy("id").collect()
    return M.Mixture(np.array([r["weight"] for r in rows]), np.array([r["m"] for r in rows]), np.array([r["s"] for r in rows]))


def _model_rows(spark, mixture: M.Mixture):
    rows = [(i, k, float(mixture.weights[i]), float(mixture.means[i, k]), float(mixture.variances[i, k])) for i in range(len(mixture.weights)) for k in range(mixture.means.shape[1])]
    return spark.createDataFrame(rows, "c int, k int, weight double, mean double, var double")


@query("sta14_expectation_maximisation")
def expectation_maximisation(spark, sf_dir):
    return _model_rows(spark, M.em(frames(spark, sf_dir), _start(spark, sf_dir)))


@query("sta16_map_adaptation")
def map_adaptation(spark, sf_dir):
    return _model_rows(spark, M.map_adapt(frames(spark, sf_dir), _start(spark, sf_dir), relevance=16.0, parameters="pmc"))


@query("sta8_k_means")
def k_means(spark, sf_dir):
    at = M.k_means(frames(spark, sf_dir), _start(spark, sf_dir).means)
    return spark.createDataFrame([(i, k, float(v)) for i, m in enumerate(at) for k, v in enumerate(m)], "c int, k int, v double")


@query("sta9_lbg_codebook")
def lbg(spark, sf_dir):
    at = M.lbg(frames(spark, sf_dir), 4)
    return spark.createDataFrame([(i, k, float(v)) for i, m in enumerate(at) for k, v in enumerate(m)], "c int, k int, v double")


@query("sta18_principal_components")
def principal_components(spark, sf_dir):
    """Frames projected on the 3 leading components; signs are not determined, so magnitudes are returned."""
    f = frames(spark, sf_dir)
    return cells(M.pca(f).apply(f, 3).withColumn("x", F.transform("x", F.abs)), "rec_id", "frame_idx")


@query("sta20_linear_discriminants")
def linear_discriminants(spark, sf_dir):
    f = frames(spark, sf_dir)
    return cells(M.lda(f, "rec_id").apply(f, 2).withColumn("x", F.transform("x", F.abs)), "rec_id", "frame_idx")


@query(
    "sta20_within_between_scatter",
    f"""WITH {FRAMES}, m AS (SELECT k, avg(v) AS m FROM cells GROUP BY k), c AS (SELECT rec_id, k, avg(v) AS mc, count(*) AS n, var_pop(v) AS s FROM cells GROUP BY ALL)
SELECT k, round(sum(n * s) / sum(n), 6) AS within, round(sum(n * (mc - m) ** 2) / sum(n), 6) AS between FROM c JOIN m USING (k) GROUP BY k""",
)
def scatter(spark, sf_dir):
    each = frames(spark, sf_dir).select("rec_id", F.posexplode("x").alias("k", "v"))
    c = each.groupBy("rec_id", "k").agg(F.avg("v").alias("mc"), F.count("*").alias("n"), F.var_pop("v").alias("s"))
    m = each.groupBy("k").agg(F.avg("v").alias("m"))
    n = F.sum("n")
    return c.join(m, "k").groupBy(F.col("k").cast("long").alias("k")).agg(F.round(F.sum(F.col("n") * F.col("s")) / n, 6).alias("within"), F.round(F.sum(F.col("n") * F.pow(F.col("mc") - F.col("m"), F.lit(2.0))) / n, 6).alias("between"))


def _sequences(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "event_type"))), lambda c: F.array_position(F.lit(SYMBOLS), c["event_type"]).cast("int"))
    return samples(spark, sf_dir).groupBy("rec_id").agg(ids.alias("symbols"))


def _chain(kind: str = "ERGODIC") -> M.Chain:
    """Three states that prefer different symbols; symbol 0 stands for names that aren't listed."""
    n = len(SYMBOLS) + 1
    chain = M.Chain.topology(kind, 3, n)
    prefer = np.array([[3.0 if s % 3 == q else 1.0 for s in range(n)] for q in range(3)])
    stay = 0.8 * np.eye(3) + 0.1 * (1 - np.eye(3)) if kind == "ERGODIC" else chain.transitions
    return M.Chain(chain.initial, stay, prefer / prefer.sum(1, keepdims=True))


@query("sta27_viterbi_decode")
def viterbi_decode(spark, sf_dir):
    out = M.decode(_sequences(spark, sf_dir), _chain())
    return out.select("rec_id", F.concat_ws(" ", F.transform("q", lambda q: q.cast("string"))).alias("q"), F.round("score", 6).alias("score"))


@query("sta27_forced_alignment")
def forced_alignment(spark, sf_dir):
    out = M.decode(_sequences(spark, sf_dir), _chain("LINEAR"), forced=True)
    return out.select("rec_id", F.concat_ws(" ", F.transform("q", lambda q: q.cast("string"))).alias("q"), F.round("score", 6).alias("score"))


def _symbols(spark, sf_dir):
    """Event types as frames of one number."""
    number = F.array_position(F.lit(SYMBOLS), F.col("event_type")).cast("double")
    return samples(spark, sf_dir).select("rec_id", F.col("idx").cast("long").alias("frame_idx"), F.when(number.isNotNull(), F.array(number)).alias("x"))


@query("sta27_symbol_states")
def symbol_states(spark, sf_dir):
    """The best state of every event along its user's events, by chunks."""
    out = H.best_states(_symbols(spark, sf_dir), H.SymbolChain.of(_chain()))
    return out.select("rec_id", "frame_idx", "q", F.round("score", 6).alias("score"))


_SHOWN = f"""{SAMPLES}, e AS (SELECT rec_id, idx, coalesce(list_position({SYMBOLS}, event_type), 0) % 3 AS p FROM samples WHERE event_type IS NOT NULL),
b AS (SELECT rec_id, idx, (CASE WHEN p = 0 THEN 3 ELSE 1 END) / 18.0::DOUBLE AS b0, (CASE WHEN p = 1 THEN 3 ELSE 1 END) / 16.0::DOUBLE AS b1, (CASE WHEN p = 2 THEN 3 ELSE 1 END) / 16.0::DOUBLE AS b2 FROM e)"""


@query(
    "sta27_sta23_record_scores",
    f"""WITH RECURSIVE {_SHOWN},
v AS (SELECT rec_id, idx, ln(b0 / 3) AS s0, ln(b1 / 3) AS s1, ln(b2 / 3) AS s2, ln(b0) AS l0, NULL::DOUBLE AS l1, NULL::DOUBLE AS l2, b0 / 3 AS f0, b1 / 3 AS f1, b2 / 3 AS f2 FROM b WHERE idx = 0
UNION ALL SELECT b.rec_id, b.idx, greatest(s0 + ln(0.8), s1 + ln(0.1), s2 + ln(0.1)) + ln(b0), greatest(s0 + ln(0.1), s1 + ln(0.8), s2 + ln(0.1)) + ln(b1), greatest(s0 + ln(0.1), s1 + ln(0.1), s2 + ln(0.8)) + ln(b2),
  l0 + ln(0.5) + ln(b0), greatest(l0, l1) + ln(0.5) + ln(b1), greatest(l1 + ln(0.5), l2) + ln(b2),
  (0.8 * f0 + 0.1 * f1 + 0.1 * f2) * b0, (0.1 * f0 + 0.8 * f1 + 0.1 * f2) * b1, (0.1 * f0 + 0.1 * f1 + 0.8 * f2) * b2 FROM v JOIN b ON b.rec_id = v.rec_id AND b.idx = v.idx + 1),
n AS (SELECT rec_id, max(idx) AS idx FROM b GROUP BY rec_id)
SELECT rec_id, round(greatest(s0, s1, s2), 6) AS best, round(l2, 6) AS forced, round(ln(f0 + f1 + f2), 6) AS likelihood FROM v JOIN n USING (rec_id, idx)""",
)
def record_scores(spark, sf_dir):
    """Each user's best path, best path through the linear chain to its end (null if there is none) and log likelihood."""
    f, chain, linear = H.chunked(_symbols(spark, sf_dir)), H.SymbolChain.of(_chain()), H.SymbolChain.of(_chain("LINEAR"))
    out = H.scores_of_chunks(f, chain, best=True).withColumnRenamed("score", "best")
    out = out.join(H.scores_of_chunks(f, linear, best=True, forced=True).withColumnRenamed("score", "forced"), "rec_id")
    out = out.join(H.scores_of_chunks(f, chain).withColumnRenamed("score", "likelihood"), "rec_id")
    return out.select("rec_id", *[F.round(F.when(F.col(c) > float("-inf"), F.col(c)), 6).alias(c) for c in ("best", "forced", "likelihood")])


@query("sta23_sta25_baum_welch")
def baum_welch(spark, sf_dir):
    """Two turns over all events, by chunks."""
    trained, lls = H.train(_symbols(spark, sf_dir), H.SymbolChain.of(_chain()), 2)
    chain = trained.chain()
    rows = [("transition", i, j, float(v)) for i, r in enumerate(chain.transitions) for j, v in enumerate(r)]
    rows += [("emission", i, j, float(v)) for i, r in enumerate(chain.emissions) for j, v in enumerate(r)] + [("log likelihood", t, 0, v) for t, v in enumerate(lls)]
    return spark.createDataFrame(rows, "part string, i int, j int, v double")


def _framed(spark, sf_dir):
    return S.overlapped(samples(spark, sf_dir).select("rec_id", "idx", "value"), 16, 8)


@query(
    "sig1_power_spectrum",
    f"""WITH {SAMPLES}, n AS (SELECT rec_id, count(*) AS n FROM samples GROUP BY rec_id), f AS (SELECT rec_id, unnest(range(CASE WHEN n < 16 THEN 1 ELSE (n - 16) // 8 + 2 END)) AS frame_idx FROM n),
p AS (SELECT f.rec_id, f.frame_idx, b AS k, sum(value * cos(2 * pi() * b * (idx - f.frame_idx * 8) / 512)) AS re, sum(value * sin(2 * pi() * b * (idx - f.frame_idx * 8) / 512)) AS im
  FROM f JOIN samples s ON s.rec_id = f.rec_id AND s.idx >= f.frame_idx * 8 AND s.idx < f.frame_idx * 8 + 16, range(4) t(b) GROUP BY ALL)
SELECT rec_id, frame_idx, k, round(CASE WHEN k = 0 THEN sqrt(re * re + im * im) ELSE re * re + im * im END, 3) AS v FROM p""",
)
def power_spectrum(spark, sf_dir):
    return _power_spectrum(spark, sf_dir, 4, 3)


@query(
    "sig1_power_spectrum_whole",
    f"""WITH {SAMPLES}, n AS (SELECT rec_id, count(*) AS n FROM samples GROUP BY rec_id), f AS (SELECT rec_id, unnest(range(CASE WHEN n < 16 THEN 1 ELSE (n - 16) // 8 + 2 END)) AS frame_idx FROM n),
p AS (SELECT f.rec_id, f.frame_idx, b AS k, sum(value * cos(2 * pi() * b * (idx - f.frame_idx * 8) / 512)) AS re, sum(value * sin(2 * pi() * b * (idx - f.frame_idx * 8) / 512)) AS im
  FROM f JOIN samples s ON s.rec_id = f.rec_id AND s.idx >= f.frame_idx * 8 AND s.idx < f.frame_idx * 8 + 16, range(257) t(b) GROUP BY ALL)
SELECT rec_id, frame_idx, k, round(CASE WHEN k = 0 THEN sqrt(re * re + im * im) ELSE re * re + im * im END, 4) + 0.0 AS v FROM p""",
)
def power_spectrum_whole(spark, sf_dir):
    """As above, all bins, at four decimals: values of two decimals give bins 128 and 256 exactly four, which three would cut at ties."""
    return _power_spectrum(spark, sf_dir, 257, 4)


def _power_spectrum(spark, sf_dir, bins, places):
    full = samples(spark, sf_dir).groupBy("rec_id").agg(F.count("*").alias("n"))
    out = _framed(spark, sf_dir).join(full, "rec_id").filter("frame_idx * 8 < n").withColumn("x", F.slice(spectral.power_spectrum(F.col("x")), 1, bins))
    return out.select("rec_id", "frame_idx", F.posexplode("x").alias("k", "v")).select("rec_id", "frame_idx", F.col("k").cast("long").alias("k"), (F.round("v", places) + F.lit(0.0)).alias("v"))


@query("sig3_mel_filter_bank")
def mel_filter_bank(spark, sf_dir):
    bank = spectral.MelBank()
    return cells(_framed(spark, sf_dir).withColumn("x", spectral.filter_bank(spectral.power_spectrum(F.col("x")), bank.weights())), "rec_id", "frame_idx")


@query("sig21_cepstrum")
def cepstrum(spark, sf_dir):
    return cells(spectral.feature_frames(_framed(spark, sf_dir)), "rec_id", "frame_idx")


@query("sig12_fft_autocorrelation")
def autocorrelation(spark, sf_dir):
    return cells(frames(spark, sf_dir).withColumn("x", spectral.fft_autocorrelation(F.col("x"))), "rec_id", "frame_idx")


@query("sig13_sig14_formants")
def formants(spark, sf_dir):
    return cells(frames(spark, sf_dir).withColumn("x", spectral.lpc_spectrum(F.col("x"))).withColumn("x", spectral.formants(F.col("x"), 8000.0, 4)), "rec_id", "frame_idx")


@query("sig15_f0_candidates")
def f0_candidates(spark, sf_dir):
    return cells(frames(spark, sf_dir).withColumn("x", spectral.fft_autocorrelation(F.col("x"))).withColumn("x", spectral.f0_candidates(F.col("x"), 2000.0, 3)), "rec_id", "frame_idx")


@query("sig16_voicing")
def voicing(spark, sf_dir):
    return cells(frames(spark, sf_dir).withColumn("x", F.slice(spectral.voicing(F.col("x"), 0.5, 0.01, 0.3), 1, 1)), "rec_id", "frame_idx")


@query("sig17_yin_pitch")
def yin_pitch(spark, sf_dir):
    return frames(spark, sf_dir).select("rec_id", "frame_idx", F.round(spectral.yin_pitch(F.col("x")), 4).alias("pitch"))


@query(
    "str8_running_statistics", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS var FROM events GROUP BY user_id"
)
def running_statistics(spark, sf_dir):
    out = streaming.running_statistics(table(spark, sf_dir, "events"))
    return out.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))


@query("str1_window_peaks", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, round(max(abs(value)), 6) AS peak, count(*) AS n FROM events GROUP BY ALL")
def window_peaks(spark, sf_dir):
    """The stream's aggregation over a finished table."""
    out = streaming.peaks(table(spark, sf_dir, "events"), "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("peak", 6).alias("peak"), "n")


@query(
    "str9_recording_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '15 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY user_id, s""",
)
def recording_sessions(spark, sf_dir):
    return streaming.sessions(table(spark, sf_dir, "events")).select("user_id", "n", r6(F.col("mean")).alias("mean"))
