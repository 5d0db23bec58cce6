"""Windows, filters, sinks, joined models, two-pass estimates and the chain from audio to speaker counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions import scalars as C
from cadenza.functions.shared import fresh_folder, rewritten
from cadenza.operators import accumulators as A
from cadenza.operators import chains as H
from cadenza.operators import clustering as G
from cadenza.operators import models as M
from cadenza.operators import nuisance as N
from cadenza.operators import sequence as S
from cadenza.operators import speakers as P
from cadenza.operators import spectral
from cadenza.plans.bindings import DIARY, FRAMES, SAMPLES, cells, diary, frames, r6, samples
from cadenza.plans.catalog import query, table
from cadenza.sources import formats, ranges, sinks
from cadenza.sources import models as model_files
from cadenza.sources.work import ChunkWork

KEYS = ("rec_id", "frame_idx")


def _folder(spark) -> str:
    return fresh_folder(spark, "files")


@query("win4_win5_windows", """SELECT 'rectangular' AS kind, i, 1.0::DOUBLE AS w FROM range(26) t(i)
UNION ALL SELECT 'triangular', i, round(CASE WHEN i < 13 THEN 2.0 * (i + 1) / 26 ELSE 2.0 * (25 - i) / 26 END, 9)::DOUBLE FROM range(26) t(i)""")
def windows(spark, sf_dir):
    rows = [(kind, i, round(float(w), 9)) for kind in ("rectangular", "triangular") for i, w in enumerate(spectral.window_weights(kind, 26))]
    return spark.createDataFrame(rows, "kind string, i long, w double")


@query("sig2_resolution", "SELECT DISTINCT length(p_name) AS frame, 8000.0::DOUBLE / 2 ** (floor(log2(length(p_name))) + 1) AS unit FROM part")
def resolutions(spark, sf_dir):
    """Hertz between the bins of frames that are filled up to the next higher power of two."""
    sizes = table(spark, sf_dir, "part").select(F.length("p_name").cast("long").alias("frame")).distinct()
    return sizes.select("frame", (F.lit(8000.0) / F.pow(F.lit(2.0), F.floor(F.log2("frame")) + 1)).alias("unit"))


_SPEC = "f,r,500,1500:f,t,1000,3000:m,t,400,1600"


@query(
    "sig4_sig5_sig6_manual_filters",
    f"""WITH {FRAMES}, spec AS (SELECT * FROM (VALUES (0, false, 500.0, 1000.0, 1500.0), (1, true, 1000.0, 2000.0, 3000.0), (2, true, 700 * (exp(400 / 1127.0) - 1), 700 * (exp(1000 / 1127.0) - 1), 700 * (exp(1600 / 1127.0) - 1))) t(f, tri, lo, mid, hi)),
b AS (SELECT f, tri, least(63, floor(lo / 62.5 + 0.5)) AS l, least(63, floor(mid / 62.5 + 0.5)) AS c, least(63, floor(hi / 62.5 + 0.5)) AS r FROM spec),
w AS (SELECT f, k, CASE WHEN NOT tri THEN 1.0 WHEN k <= c THEN (k - l + 1) / (c - l + 1) ELSE 1 - (k - c) / (r - c + 1) END AS w FROM b, range(64) t(k) WHERE k BETWEEN l AND r),
n AS (SELECT f, sum(w) AS n FROM w GROUP BY f)
SELECT rec_id, frame_idx, f::BIGINT AS k, round(ln(sum(v * v * w) / n + 1e-6), 6) + 0.0 AS v FROM cells JOIN w USING (k) JOIN n USING (f) GROUP BY rec_id, frame_idx, f, n""",
)
def manual_filters(spark, sf_dir):
    """Logarithms of a bank by specification, over squared components as the 64 bins of a spectrum up to 4 kHz."""
    weights = spectral.filter_weights(_SPEC, 64, 62.5)
    squared = frames(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v * v))
    return cells(squared.withColumn("x", spectral.filter_bank(F.col("x"), weights)), *KEYS)


_TAIL = "(-1.000182518760158122 * r + 0.029814187308200211 + (4.120411523939115059 * r + 16.682320830719986527) / (r * r + 8.759693508958633869 * r + 7.173787663925508066))"


@query(
    "scl13_normal_quantile",
    f"""WITH p AS (SELECT o_orderkey, (o_orderkey % 9999 + 0.5) / 9999.0 AS p FROM orders), q AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS r, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS s FROM p)
SELECT o_orderkey, round(CASE WHEN p < 0.0465 THEN {_TAIL} WHEN p > 1 - 0.0465 THEN -{_TAIL}
  ELSE q * (1.246899760652504 + (-0.652871358365296 * s + 0.195740115269792) / (s * s - 0.839293158122257 * s + 0.155331081623468)) END, 6) + 0.0 AS z FROM q""",
)
def normal_quantile(spark, sf_dir):
    p = (F.col("o_orderkey") % 9999 + 0.5) / 9999.0
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(C.normal_quantile(p)).alias("z"))


@query("scl16_timestamped_files", "SELECT event_id, strftime(ts, '%Y.%m.%d.%H.%M.%S') || '.' || lpad(((date_part('microsecond', ts) // 1000) % 1000)::VARCHAR, 3, '0') || '.wav' AS name FROM events")
def timestamped_files(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.file_on_time(F.col("ts"), "wav").alias("name"))


@query(
    "scl17_selection_strings",
    """WITH i AS (SELECT s_suppkey, unnest(list_concat([s_nationkey], range(s_nationkey, s_nationkey + 4), [s_suppkey])) AS i, generate_subscripts(list_concat([s_nationkey], range(s_nationkey, s_nationkey + 4), [s_suppkey]), 1) - 1 AS pos FROM supplier)
SELECT s_suppkey, pos::BIGINT AS pos, i::BIGINT AS i FROM i""",
)
def selection_strings(spark, sf_dir):
    n = F.col("s_nationkey").cast("int")
    spec = F.concat(n.cast("string"), F.lit(","), n.cast("string"), F.lit("-"), (n + 3).cast("string"), F.lit(","), F.col("s_suppkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(C.selection_indices(spec)).alias("pos", "i"))
    return rows.select("s_suppkey", F.col("pos").cast("long").alias("pos"), F.col("i").cast("long").alias("i"))


@query("flt8_saturated_windows", f"WITH {SAMPLES}, w AS (SELECT rec_id, idx // 5 AS win, max(abs(value)) AS peak FROM samples GROUP BY ALL), t AS (SELECT max(peak) AS top FROM w) SELECT rec_id, win, round(peak, 6) AS peak FROM w, t WHERE peak > 0.999 * top / 2")
def saturated_windows(spark, sf_dir):
    """Windows beyond 0.999 of half the table's largest amplitude."""
    peaks = samples(spark, sf_dir).groupBy("rec_id", F.floor(F.col("idx") / 5).alias("win")).agg(F.max(F.abs("value")).alias("peak"))
    full = samples(spark, sf_dir).agg(F.max(F.abs("value"))).first()[0]
    return peaks.filter(C.saturated(F.col("peak"), full / 2)).select("rec_id", "win", F.round("peak", 6).alias("peak"))


@query("agg7_two_pass_gaussian", f"""WITH {FRAMES}, m AS (SELECT k, avg(v) AS m FROM cells GROUP BY k), c AS (SELECT rec_id, frame_idx, k, v - m AS v FROM cells JOIN m USING (k))
SELECT a.k AS i, b.k AS j, round(avg(a.v * b.v), 6) + 0.0 AS v FROM c a JOIN c b ON a.rec_id = b.rec_id AND a.frame_idx = b.frame_idx AND b.k <= a.k GROUP BY ALL""")
def two_pass(spark, sf_dir):
    """The lower triangle of the full covariance of whole vectors."""
    _, cov = M.two_pass_gaussian(frames(spark, sf_dir))
    rows = [(int(i), int(j), round(float(cov[i, j]), 6) + 0.0) for i, j in zip(*np.tril_indices(len(cov)), strict=True)]
    return spark.createDataFrame(rows, "i long, j long, v double")


@query("sta7_interpolated_gaussians", f"""WITH {FRAMES}, g AS (SELECT rec_id AS c, k, avg(v) AS m, greatest(var_pop(v), 1e-10) AS s FROM cells GROUP BY ALL), o AS (SELECT k, m AS om, s AS os FROM g WHERE c = 0)
SELECT c, k, round(0.75 * m + 0.25 * om, 6) + 0.0 AS m, round(0.75 * s + 0.25 * os, 6) AS s FROM g JOIN o USING (k)""")
def interpolated(spark, sf_dir):
    g = M.class_gaussians(frames(spark, sf_dir), "rec_id")
    moved = M.interpolate_gaussians(g, g.filter("id = 0"), 0.25)
    flat = moved.select(F.col("id").alias("c"), F.posexplode(F.arrays_zip("m", "s")).alias("k", "z"))
    return flat.select("c", F.col("k").cast("long").alias("k"), r6(F.col("z.m")).alias("m"), F.round("z.s", 6).alias("s"))


@query("jn6_shared_codebooks", f"WITH {FRAMES}, cb AS (SELECT rec_id AS cb_id, round(avg(v), 9) AS level FROM cells GROUP BY rec_id) SELECT event_id, cb_id, round(level, 6) + 0.0 AS level FROM (SELECT event_id, event_id % (SELECT count(*) FROM cb) AS cb_id FROM events) JOIN cb USING (cb_id)")
def codebooks(spark, sf_dir):
    books = frames(spark, sf_dir).select(F.col("rec_id").cast("long").alias("cb_id"), F.explode("x").alias("v")).groupBy("cb_id").agg(F.avg("v").alias("level"))
    states = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % books.count()).alias("cb_id"))
    return M.shared_codebooks(states, books, "cb_id").select("event_id", "cb_id", r6(F.col("level")).alias("level"))


@query("set3_joined_chains", """WITH s AS (SELECT i, CASE WHEN i < 3 THEN 0 WHEN i < 5 THEN 1 ELSE 2 END AS m, i IN (2, 4, 8) AS ends FROM range(9) t(i))
SELECT i, j, CASE WHEN i = 8 THEN CASE WHEN j = 8 THEN 1.0 ELSE 0.0 END WHEN j IN (i, i + 1) THEN 0.5 ELSE 0.0 END::DOUBLE AS a FROM s, range(9) t(j)""")
def chain_of_chains(spark, sf_dir):
    """Transitions of three linear models of 3, 2 and 4 states, one after the other."""
    joined = M.joined_chains([M.Chain.topology("LINEAR", n, 2) for n in (3, 2, 4)])
    return spark.createDataFrame([(i, j, float(a)) for i, row in enumerate(joined.transitions) for j, a in enumerate(row)], "i long, j long, a double")


def _tests(spark, sf_dir):
    d = diary(spark, sf_dir)
    return d.select(F.concat(F.lit("rec-"), F.col("_id").cast("string"), F.lit(".wav")).alias("file"), "date", F.lit("09:00").alias("start"), F.lit("09:05").alias("end"), "n", F.format_string("%.2f", "percentage").alias("percentage"), F.lit("-1.0").alias("latitude"), F.lit("-1.0").alias("longitude"))


@query("snk10_snk6_test_log", f"""WITH {DIARY} SELECT 'rec-' || _id || '.wav' || chr(9) || 'Date:' || chr(9) || date || chr(9) || 'start:' || chr(9) || '09:00' || chr(9) || 'end:' || chr(9) || '09:05' || chr(9) || 'speaker count:' || chr(9) || n
  || chr(9) || 'speach percentage:' || chr(9) || printf('%.2f', percentage) || chr(9) || 'latitude:' || chr(9) || '-1.0' || chr(9) || 'longitude:' || chr(9) || '-1.0' AS value FROM diary""")
def test_log(spark, sf_dir):
    """Log lines appended to text files and read back."""
    folder = _folder(spark)
    sinks.append_lines(sinks.test_log_lines(_tests(spark, sf_dir)), folder)
    return spark.read.text(folder)


@query("snk8_test_insert", f"WITH {DIARY} SELECT _id, date, n, percentage FROM diary UNION ALL SELECT _id, date, n, percentage FROM diary WHERE n > 5")
def test_insert(spark, sf_dir):
    """Two inserts into the table of tests."""
    folder, rows = _folder(spark), diary(spark, sf_dir).select("_id", "date", "n", "percentage")
    sinks.append_tests(rows, folder)
    return sinks.append_tests(rows.filter("n > 5"), folder)


@query("snk1_src9_frame_files", f"WITH {FRAMES} SELECT rec_id::BIGINT AS rec_id, frame_idx, k, round(v::FLOAT::DOUBLE, 6) + 0.0 AS v FROM cells")
def frame_files(spark, sf_dir):
    """Single precision frame files, one a record, written by the tasks that sorted it and read back."""
    folder = _folder(spark)
    sinks.write_frame_files(frames(spark, sf_dir), folder).count()
    back = formats.read_frames(spark, folder).withColumn("rec_id", F.regexp_extract("rec_id", r"([^/]+)\.ft$", 1).cast("long"))
    return cells(back, *KEYS)


@query("snk3_src12_sample_files", f"WITH {FRAMES} SELECT rec_id::BIGINT AS rec_id, frame_idx AS idx, (frame_idx % 7)::BIGINT AS c, k, round(v::FLOAT::DOUBLE, 6) + 0.0 AS v FROM cells")
def sample_files(spark, sf_dir):
    folder = _folder(spark)
    rows = frames(spark, sf_dir).select("rec_id", F.col("frame_idx").alias("idx"), (F.col("frame_idx") % 7).alias("c"), F.lit(0).alias("y"), "x")
    sinks.write_sample_files(rows, folder).count()
    back = formats.read_samples(spark, folder).select(F.regexp_extract("rec_id", r"([^/]+)\.samples$", 1).cast("long").alias("rec_id"), "idx", F.col("c").cast("long").alias("c"), "x")
    return cells(back, "rec_id", "idx", "c")


@query("snk4_src1_wav_files", f"WITH {SAMPLES}, t AS (SELECT max(abs(value)) AS top FROM samples) SELECT rec_id, idx, round(floor(value / top * 32767 + 0.5) / 32767, 6) + 0.0 AS value FROM samples, t")
def wav_files(spark, sf_dir):
    folder, s = _folder(spark), samples(spark, sf_dir)
    top = s.agg(F.max(F.abs("value"))).first()[0]
    sinks.write_wav_files(s.select("rec_id", "idx", (F.col("value") / top).alias("value")), folder).count()
    back = formats.sample_rows(formats.read_audio(spark, folder))
    return back.select(F.regexp_extract("rec_id", r"([^/]+)\.wav$", 1).cast("long").alias("rec_id"), "idx", r6(F.col("value")).alias("value"))


@query("src4_concatenated_audio", f"""WITH {SAMPLES}, t AS (SELECT max(abs(value)) AS top FROM samples), n AS (SELECT rec_id, count(*) AS n, (count(*) + 15) // 16 * 16 AS filled FROM samples GROUP BY rec_id),
b AS (SELECT *, coalesce(sum(filled) OVER (ORDER BY rec_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM n)
SELECT (b.begin + r.i)::BIGINT AS idx, coalesce(round(floor(value / top * 32767 + 0.5) / 32767, 6), 0) + 0.0 AS value, 1::BIGINT AS skipped
FROM b, LATERAL (SELECT unnest(range(b.filled)) AS i) r, t LEFT JOIN samples s ON s.rec_id = b.rec_id AND s.idx = r.i""")
def concatenated_audio(spark, sf_dir):
    """Recordings one after the other in the order of a list, each filled up to whole buffers; a listed file that isn't there is reported."""
    folder, s = _folder(spark), samples(spark, sf_dir)
    top = s.agg(F.max(F.abs("value"))).first()[0]
    files = sinks.write_wav_files(s.select("rec_id", "idx", (F.col("value") / top).alias("value")), folder)
    ids = s.select("rec_id").distinct()
    files.count()
    listed = ids.select((-F.col("rec_id")).alias("pos"), F.concat(F.lit(f"{folder}/"), F.col("rec_id").cast("string"), F.lit(".wav")).alias("path"))
    listed = listed.unionByName(spark.range(1).select(F.lit(-3).cast("long").alias("pos"), F.lit(f"{folder}/missing.wav").alias("path")))
    rows, skipped = formats.concatenated_audio(listed, buffer=16)
    return rows.select("idx", r6(F.col("value")).alias("value"), F.lit(skipped.count()).cast("long").alias("skipped"))


@query("snk16_conversion", f"WITH {FRAMES} SELECT round((floor(v * 1000 + 0.5) / 1000)::FLOAT::DOUBLE, 6) + 0.0 AS v, count(*) AS n FROM cells GROUP BY ALL")
def conversion(spark, sf_dir):
    """Frames as double precision files, converted to text of three decimals and on to single precision files."""
    return _converted(spark, sf_dir).select(F.explode("x").alias("v")).groupBy(r6(F.col("v")).alias("v")).agg(F.count("*").alias("n"))


@query("snk16_conversion_by_record", f"WITH {FRAMES} SELECT rec_id::BIGINT AS rec_id, frame_idx, k, round((floor(v * 1000 + 0.5) / 1000)::FLOAT::DOUBLE, 6) + 0.0 AS v FROM cells")
def conversion_by_record(spark, sf_dir):
    """As above: records and the order of their frames come through the text."""
    return cells(_converted(spark, sf_dir), *KEYS)


def _converted(spark, sf_dir):
    """Each form is written and read by record, so by as many tasks as there are records."""
    first, second, third = (_folder(spark) for _ in range(3))
    sinks.write_as(frames(spark, sf_dir), first, "double")
    named = sinks.read_as(spark, first, "double").withColumn("rec_id", F.regexp_extract("rec_id", r"([^/]+)\.ft$", 1))
    sinks.write_as(named, second, "ascii")
    sinks.write_as(sinks.read_as(spark, second, "ascii", 64), third, "float")
    return sinks.read_as(spark, third, "float").withColumn("rec_id", F.regexp_extract("rec_id", r"([^/]+)\.ft$", 1).cast("long"))


@query("src26_audio_formats", """SELECT * FROM (VALUES ('ssg/16', 16, 16000, 0, NULL), ('ssg/8', 16, 8000, 0, NULL), ('ulaw/16', 8, 16000, 0, 'ulaw'), ('ulaw/8', 8, 8000, 0, 'ulaw'), ('alaw/16', 8, 16000, 0, 'alaw'), ('alaw/8', 8, 8000, 0, 'alaw'),
 ('sphere/8', 8, 8000, 1024, 'ulaw'), ('wav/44', 16, 44100, 44, NULL), ('wav/32', 16, 32000, 44, NULL), ('wav/16', 16, 16000, 44, NULL), ('wav/8', 16, 8000, 44, NULL)) t(name, bits, rate, header, law)""")
def audio_formats(spark, sf_dir):
    rows = [(name, *(sinks.audio_format(name)[k] for k in ("bits", "rate", "header", "law"))) for name in sinks.AUDIO_FORMATS]
    return spark.createDataFrame(rows, "name string, bits int, rate int, header int, law string")


def _features(spark, sf_dir):
    """Coefficients with deltas, normalised, and pitches of the framed samples."""
    framed = S.overlapped(samples(spark, sf_dir).select("rec_id", "idx", "value"), 16, 8)
    return spectral.feature_frames(framed), framed.select("rec_id", "frame_idx", spectral.yin_pitch(F.col("x"), threshold=0.8).alias("pitch"))


@query("sig21_mfcc_chain")
def mfcc_chain(spark, sf_dir):
    """Window, spectrum, mel filters, DCT, selection of coefficients 0 to 11, deltas of context 3, mean and variance normalised by record."""
    static, _ = _features(spark, sf_dir)
    static = static.withColumn("x", F.slice("x", 1, 12))
    both = static.join(S.regression_delta(static, 3).withColumnRenamed("x", "delta"), ["rec_id", "frame_idx"]).withColumn("x", F.concat("x", "delta"))
    flat = both.select(*KEYS, F.posexplode("x").alias("k", "v"))
    stats = flat.groupBy("rec_id", "k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    normal = F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0)
    return flat.join(stats, ["rec_id", "k"]).select(*KEYS, F.col("k").cast("long").alias("k"), r6(normal).alias("v"))


@query("sig18_threshold_strategies")
def threshold_strategies(spark, sf_dir):
    """Thresholds of window energies: their mean, and the boundary of two Gaussians after 0, 1 and 6 turns."""
    windows = samples(spark, sf_dir).groupBy("rec_id", F.floor(F.col("idx") / 5).alias("win")).agg(F.array(F.sum(F.abs("value"))).alias("x"))
    return spark.createDataFrame([(s, round(M.energy_threshold(windows, s), 6)) for s in ("mean", "cluster", "em1", "em5")], "strategy string, threshold double")


VOICE = P.Voice(0.05, 50.0, 4000.0, 4000.0, 160.0, 190.0)


@query("spk7_spk2_count_from_samples")
def count_from_samples(spark, sf_dir):
    """Samples to features and pitches, to voiced segments, to speakers, as rows of the table of tests."""
    features, pitches = _features(spark, sf_dir)
    return P.count_in_recordings(features, pitches, 0.064, VOICE, *P.DEFAULT_DEVICE)


@query("spk8_spk1_calibrate_owners")
def calibrate_owners(spark, sf_dir):
    """Owners whose voiced segments suffice, with frames and mean pitch."""
    features, pitches = _features(spark, sf_dir)
    return P.owner_model(features, pitches, 0.064, VOICE, 0.064).select("rec_id", "n", F.round("pitch", 4).alias("pitch"))


@query(
    "sig16_voicing_flags",
    f"""WITH {FRAMES}, n AS (SELECT rec_id, frame_idx, sum(CASE WHEN v * w <= -1 THEN 1 ELSE 0 END) / 64.0 AS zc FROM (SELECT *, lead(v) OVER (PARTITION BY rec_id, frame_idx ORDER BY k) AS w FROM cells) GROUP BY ALL),
e AS (SELECT rec_id, frame_idx, sum(v * v) / 64 AS e, max(abs(v)) AS p FROM cells GROUP BY ALL)
SELECT rec_id, frame_idx, CASE WHEN zc <= 0.5 AND e >= 0.01 AND p >= 0.3 THEN 1.0 ELSE 0.0 END::DOUBLE AS voiced FROM n JOIN e USING (rec_id, frame_idx)""",
)
def voicing_flags(spark, sf_dir):
    return frames(spark, sf_dir).select(*KEYS, F.element_at(spectral.voicing(F.col("x"), 0.5, 0.01, 0.3), 1).alias("voiced"))


_ACF = f"""{FRAMES}, h AS (SELECT k, 0.54 - 0.46 * cos(2 * pi() * k / 63.0) AS h FROM range(64) t(k)),
wa AS (SELECT b.k - a.k AS lag, sum(a.h * b.h) AS w FROM h a JOIN h b ON b.k - a.k BETWEEN 0 AND 31 GROUP BY ALL),
xa AS (SELECT a.rec_id, a.frame_idx, b.k - a.k AS lag, sum(a.v * b.v) AS v FROM cells a JOIN cells b ON a.rec_id = b.rec_id AND a.frame_idx = b.frame_idx AND b.k - a.k BETWEEN 0 AND 31 GROUP BY ALL),
acf AS (SELECT x.rec_id, x.frame_idx, x.lag AS k, x.v / z.v / (w.w / w0.w) AS v FROM xa x JOIN xa z ON x.rec_id = z.rec_id AND x.frame_idx = z.frame_idx AND z.lag = 0 JOIN wa w ON w.lag = x.lag JOIN wa w0 ON w0.lag = 0)"""


@query("sig12_autocorrelation", f"WITH {_ACF} SELECT rec_id, frame_idx, k, round(v, 6) + 0.0 AS v FROM acf")
def autocorrelation(spark, sf_dir):
    return cells(frames(spark, sf_dir).withColumn("x", spectral.fft_autocorrelation(F.col("x"))), *KEYS)


@query("sta22_blockwise_nuisance_training")
def blockwise_training(spark, sf_dir):
    """Each 16 components without the two leading directions within the classes of their own."""
    f = frames(spark, sf_dir)
    return cells(G.remove_block_nuisance(f, G.block_nuisance_bases(f, "rec_id", 2, 4)), *KEYS)


@query("sta28_mixture_emissions")
def mixture_emissions(spark, sf_dir):
    """Frames of each class along a linear chain of three states, whose mixtures are the Gaussians of classes 0 to 2."""
    f = frames(spark, sf_dir)
    rows = M.class_gaussians(f, "rec_id").filter("id < 3").orderBy("id").collect()
    states = [M.Mixture(np.array([1.0]), np.array([r["m"]]), np.array([r["s"]])) for r in rows]
    listed = f.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))), lambda c: c["x"]).alias("frames"))
    out = M.decode_frames(listed, M.Chain.topology("LINEAR", 3, 1), lambda x: M.mixture_emissions(x, states))
    return out.select("rec_id", F.concat_ws(" ", F.transform("q", lambda q: q.cast("string"))).alias("q"), F.round("score", 4).alias("score"))


def _class_mixture(f) -> M.Mixture:
    """The Gaussians of all classes, by class."""
    rows = M.class_gaussians(f, "rec_id").orderBy("id").collect()
    return M.Mixture(np.array([r["weight"] for r in rows]), np.array([r["m"] for r in rows]), np.array([r["s"] for r in rows]))


def _own_mixtures(f) -> H.FrameChain:
    """States that start from two classes' Gaussians each, the last one from what is left."""
    whole = _class_mixture(f)
    pairs = [slice(i, i + 2) for i in range(0, len(whole.weights), 2)]
    states = [M.Mixture(whole.weights[p] / whole.weights[p].sum(), whole.means[p], whole.variances[p]) for p in pairs]
    return H.FrameChain.of_mixtures(M.Chain.topology("ERGODIC", len(states), 1), states)


def _shared_codebook(f) -> H.FrameChain:
    """Three states over one codebook of all classes' Gaussians, each of which prefers another third of it."""
    book = _class_mixture(f)
    prefer = np.array([[3.0 if c % 3 == s else 1.0 for c in range(len(book.weights))] for s in range(3)])
    return H.FrameChain.of_codebook(M.Chain.topology("ERGODIC", 3, 1), book, prefer / prefer.sum(1, keepdims=True))


def _trained(spark, chain: H.FrameChain, lls: list[float]):
    rows = [(part, i, j, float(v)) for part in ("transitions", "weights", "means", "variances") for i, r in enumerate(getattr(chain, part)) for j, v in enumerate(r)]
    rows += [("initial", i, 0, float(v)) for i, v in enumerate(chain.initial)] + [("log likelihood", t, 0, v) for t, v in enumerate(lls)]
    return spark.createDataFrame(rows, "part string, i int, j int, v double")


@query("sta28_train_mixtures")
def train_mixtures(spark, sf_dir):
    """Three turns over the frames of every class, states with mixtures of their own."""
    f = frames(spark, sf_dir)
    return _trained(spark, *H.train(f, _own_mixtures(f), 3))


@query("sta28_train_shared_codebook")
def train_shared_codebook(spark, sf_dir):
    """Three turns over the frames of every class, states that share a codebook."""
    f = frames(spark, sf_dir)
    return _trained(spark, *H.train(f, _shared_codebook(f), 3))


@query("sta28_sta27_best_states")
def best_states(spark, sf_dir):
    """The best state of every frame along its class, by chunks."""
    f = frames(spark, sf_dir)
    return H.best_states(f, _own_mixtures(f)).select("rec_id", "frame_idx", "q", F.round("score", 4).alias("score"))


@query(
    "sta21_channel_scatter",
    f"""WITH {FRAMES}, n AS (SELECT rec_id, count(*) AS n FROM frames GROUP BY rec_id), t AS (SELECT count(*) AS t FROM frames),
s AS (SELECT rec_id, k, sum(v) AS s FROM cells GROUP BY ALL), w AS (SELECT k, sum(s) AS s FROM s GROUP BY k),
q AS (SELECT a.k AS i, b.k AS j, sum((t - n) * a.v * b.v) AS v FROM cells a JOIN cells b USING (rec_id, frame_idx) JOIN n USING (rec_id), t WHERE b.k <= a.k GROUP BY ALL),
c AS (SELECT a.k AS i, b.k AS j, sum(a.s * b.s) AS v FROM s a JOIN s b USING (rec_id) GROUP BY ALL)
SELECT i, j, round((q.v + c.v - a.s * b.s) / t / t, 8) + 0.0 AS v FROM q JOIN c USING (i, j) JOIN w a ON a.k = i JOIN w b ON b.k = j, t""",
)
def channel_scatter(spark, sf_dir):
    """Scatter between frames of different classes, a pair's share of all pairs."""
    f = frames(spark, sf_dir)
    whole = N.scatter(N.channel_rows(f, "rec_id")) / float(f.count()) ** 2
    return spark.createDataFrame([(i, j, float(whole[i, j])) for i in range(len(whole)) for j in range(i + 1)], "i long, j long, v double").select("i", "j", (F.round("v", 8) + 0.0).alias("v"))


@query("sta21_channel_compensation")
def channel_compensation(spark, sf_dir):
    """Frames without the two leading directions between classes."""
    f = frames(spark, sf_dir)
    return cells(G.remove_nuisance(f, N.directions(N.channel_rows(f, "rec_id"), 2)[0]), *KEYS)


@query("sta21_session_compensation")
def session_compensation(spark, sf_dir):
    """Frames without the two leading directions between frames of one place in different classes, by subspace iteration."""
    f = frames(spark, sf_dir)
    rows = rewritten(N.session_rows(f, "rec_id", "frame_idx", ragged=True), "pairs")
    return cells(G.remove_nuisance(f, N.directions(rows, 2, widest=0)[0]), *KEYS)


@query("src14_resumable_chunks", f"WITH {FRAMES} SELECT rec_id::BIGINT AS rec_id, count(DISTINCT frame_idx) AS n, round(sum(v::FLOAT::DOUBLE), 6) + 0.0 AS v FROM cells GROUP BY rec_id")
def resumable_chunks(spark, sf_dir):
    """Frame files as a list of chunks: three batches of it are run, the rest by another start, each file once."""
    folder = _folder(spark)
    written = sinks.write_frame_files(frames(spark, sf_dir), folder)
    written.count()
    files = ranges.listed(spark, folder, "*.ft").select(F.col("path").alias("chunk"))

    def work(chunks):
        paths = [r["chunk"] for r in chunks.collect()]  # the names of one batch
        each = formats.read_frames(spark, paths)
        total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
        return each.groupBy(F.regexp_extract("rec_id", r"([^/]+)\.ft$", 1).cast("long").alias("rec_id")).agg(F.count("*").alias("n"), F.sum(total).alias("v"))

    at = _folder(spark)
    ChunkWork.create(files, at, 8).run(work, 3)
    again = ChunkWork(spark, at)
    again.run(work)
    return again.results().select("rec_id", "n", r6(F.col("v")).alias("v"))


@query(
    "snk14_src21_full_mixture_file",
    f"""WITH {FRAMES}, m AS (SELECT rec_id, k, avg(v) AS m FROM cells GROUP BY ALL)
SELECT rec_id::BIGINT AS rec_id, i, j, round(v, 6) + 0.0 AS v FROM (SELECT a.rec_id, a.k AS i, b.k AS j, avg((a.v - ma.m) * (b.v - mb.m)) AS v
  FROM cells a JOIN cells b ON a.rec_id = b.rec_id AND a.frame_idx = b.frame_idx AND b.k <= a.k JOIN m ma ON ma.rec_id = a.rec_id AND ma.k = a.k JOIN m mb ON mb.rec_id = b.rec_id AND mb.k = b.k GROUP BY ALL)
UNION ALL SELECT rec_id::BIGINT, k, -1, round(m, 6) + 0.0 FROM m""",
)
def full_mixture_file(spark, sf_dir):
    """Means (j = -1) and covariances of the classes, written as a mixture of full covariances and read back."""
    stats = A.statistics(frames(spark, sf_dir)).orderBy("rec_id").collect()  # a row per class
    n = np.array([r["n"] for r in stats], float)
    means = np.array([r["s"] for r in stats]) / n[:, None]
    low = np.tril_indices(means.shape[1])
    at = f"{_folder(spark)}/classes.mixture"
    model_files.save(at, model_files.full_mixture_bytes(n / n.sum(), means, np.array([r["q"] for r in stats]) / n[:, None] - means[:, low[0]] * means[:, low[1]]))
    _, means, packed = model_files.full_mixture_of(model_files.load(at))
    rows = [(int(r["rec_id"]), int(i), int(j), float(v)) for r, p in zip(stats, packed, strict=True) for i, j, v in zip(*low, p, strict=True)]
    rows += [(int(r["rec_id"]), i, -1, float(v)) for r, m in zip(stats, means, strict=True) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "rec_id long, i long, j long, v double").select("rec_id", "i", "j", r6(F.col("v")).alias("v"))
