"""Sample, state-sequence, diary and speaker queries over events, orders, customers and embeddings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import scalars as C
from cadenza.functions import vectors as V
from cadenza.operators import sequence as S
from cadenza.operators import speakers as P
from cadenza.plans.bindings import DIARY, FRAMES, SAMPLES, diary, frames, r6, samples
from cadenza.plans.catalog import query, table

_O = "OVER (PARTITION BY rec_id ORDER BY idx)"


def _over(a: int | str, b: int | str) -> str:
    side = lambda v, w: "UNBOUNDED PRECEDING" if v == "all" else "CURRENT ROW" if v == 0 else f"{abs(v)} {'PRECEDING' if v < 0 else 'FOLLOWING'}"
    return f"OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN {side(a, 0)} AND {side(b, 1)})"


@query(
    "win1_overlapped_framing",
    f"""WITH {SAMPLES}, n AS (SELECT rec_id, count(*) AS n FROM samples GROUP BY rec_id),
f AS (SELECT rec_id, unnest(range(CASE WHEN n < 8 THEN 1 ELSE (n - 8) // 4 + 2 END)) AS frame_idx FROM n)
SELECT f.rec_id, f.frame_idx, count(value) AS filled, round(coalesce(sum(value), 0), 6) AS total FROM f LEFT JOIN samples s ON s.rec_id = f.rec_id AND s.idx >= f.frame_idx * 4 AND s.idx < f.frame_idx * 4 + 8 GROUP BY ALL""",
)
def framing(spark, sf_dir):
    framed = S.overlapped(samples(spark, sf_dir), 8, 4)
    s = samples(spark, sf_dir).groupBy("rec_id").agg(F.count("*").alias("n"))
    filled = F.greatest(F.lit(0), F.least(F.lit(8), F.col("n") - F.col("frame_idx") * 4))
    return framed.join(s, "rec_id").select("rec_id", "frame_idx", filled.cast("long").alias("filled"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("prj12_pre_emphasis", f"WITH {SAMPLES} SELECT rec_id, idx, round(value - 0.95 * coalesce(lag(value) {_O}, 0), 6) + 0.0 AS value FROM samples")
def pre_emphasis(spark, sf_dir):
    return S.pre_emphasis(samples(spark, sf_dir)).select("rec_id", "idx", r6(F.col("value")).alias("value"))


@query("prj14_running_dc_removal", f"WITH {SAMPLES} SELECT rec_id, idx, round(value - avg(value) {_over(-15, 0)}, 6) + 0.0 AS value FROM samples")
def running_dc(spark, sf_dir):
    mean = F.avg("value").over(S.sample_order().rowsBetween(-15, 0))
    return samples(spark, sf_dir).select("rec_id", "idx", r6(F.col("value") - mean).alias("value"))


@query("prj16_label_ids", f"SELECT doc_id, CASE WHEN length(substr(text, 1, 1)) = 1 THEN strpos('{C.ALPHABET}', substr(text, 1, 1)) - 1 ELSE -1 END AS id FROM documents")
def label_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.label_to_id(F.substring("text", 1, 1)).cast("long").alias("id"))


@query("win6_agg14_window_energy", f"""WITH {SAMPLES}, m AS (SELECT *, avg(value) {_over('all', 0)} AS mean FROM samples)
SELECT rec_id, idx // 5 AS win, round(sum(abs(value - mean)), 6) AS energy, round(max(abs(value)), 6) AS peak FROM m GROUP BY ALL""")
def window_energy(spark, sf_dir):
    return S.running_energy(samples(spark, sf_dir), 5).select("rec_id", "win", F.round("energy", 6).alias("energy"), F.round("peak", 6).alias("peak"))


_MASK = f"voiced AS (SELECT rec_id, idx, (value > avg(value) OVER (PARTITION BY rec_id))::INT AS speech FROM samples)"


def _mask(spark, sf_dir):
    return S.above_mean(samples(spark, sf_dir)).select("rec_id", "idx", "speech")


_AT = {j: f"coalesce({'lead' if j > 0 else 'lag'}(speech, {abs(j)}) {_O}, {'last' if j > 0 else 'first'}(speech) OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))" for j in (-2, -1, 1, 2)}


@query("win10_voicing_smoothing", f"""WITH {SAMPLES}, {_MASK}, n AS (SELECT *, {_AT[-2]} AS a, {_AT[-1]} AS b, {_AT[1]} AS c, {_AT[2]} AS d FROM voiced)
SELECT rec_id, idx, CASE WHEN speech = 1 AND NOT (a + b = 2 OR b + c = 2 OR c + d = 2) THEN 0 WHEN speech = 0 AND b + c = 2 THEN 1 ELSE speech END AS speech FROM n""")
def voicing_smoothing(spark, sf_dir):
    return S.smooth_voicing(_mask(spark, sf_dir).withColumnRenamed("idx", "frame_idx"), "speech").select("rec_id", F.col("frame_idx").alias("idx"), "speech")


@query("win12_closing_opening", f"""WITH {SAMPLES}, {_MASK}, s1 AS (SELECT rec_id, idx, max(speech) {_over(-2, 2)} AS m FROM voiced), s2 AS (SELECT rec_id, idx, min(m) {_over(-2, 2)} AS m FROM s1),
s3 AS (SELECT rec_id, idx, min(m) {_over(-2, 2)} AS m FROM s2) SELECT rec_id, idx, max(m) {_over(-2, 2)} AS speech FROM s3""")
def closing_opening(spark, sf_dir):
    return S.close_then_open(_mask(spark, sf_dir), 2)


@query("win15_silence_ends", f"""WITH {SAMPLES}, {_MASK} SELECT rec_id, coalesce(min(idx) FILTER (speech = 1), count(*)) AS initial, count(*) - 1 - coalesce(max(idx) FILTER (speech = 1), -1) AS terminal FROM voiced GROUP BY rec_id""")
def silence_ends(spark, sf_dir):
    return S.silence_ends(_mask(spark, sf_dir))


@query("sig20_speech_string", f"WITH {SAMPLES}, {_MASK} SELECT rec_id, string_agg(speech::VARCHAR, '' ORDER BY idx) AS mask FROM voiced GROUP BY rec_id")
def speech_string(spark, sf_dir):
    listed = F.array_sort(F.collect_list(F.struct("idx", "speech")))
    return _mask(spark, sf_dir).groupBy("rec_id").agg(F.array_join(F.transform(listed, lambda c: c["speech"].cast("string")), "").alias("mask"))


@query("win13_segments", f"WITH {SAMPLES} SELECT rec_id, idx // 7 AS seg_id, count(*) AS n, min(idx) AS first, max(idx) AS last FROM samples GROUP BY ALL")
def segment_bounds(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("rec_id", F.floor(F.col("idx") / 7).alias("seg_id")).agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


@query("win14_cumulative_mean", f"WITH {SAMPLES} SELECT rec_id, idx, round(value * (idx + 1) / sum(value) {_over('all', 0)}, 6) AS d FROM samples")
def cumulative_mean(spark, sf_dir):
    so_far = F.sum("value").over(S.sample_order().rowsBetween(W.unboundedPreceding, 0))
    return samples(spark, sf_dir).select("rec_id", "idx", F.round(V.quotient(F.col("value") * (F.col("idx") + 1), so_far), 6).alias("d"))


@query("win17_linear_alignment", f"WITH {SAMPLES}, n AS (SELECT rec_id, count(*) AS n FROM samples GROUP BY rec_id) SELECT rec_id, idx, idx * 3 // n AS q FROM samples JOIN n USING (rec_id)")
def linear_alignment(spark, sf_dir):
    n = F.count("*").over(W.partitionBy("rec_id"))
    return samples(spark, sf_dir).select("rec_id", "idx", F.floor(F.col("idx") * 3 / n).alias("q"))


@query("agg2_agg4_list_statistics", f"WITH {SAMPLES} SELECT rec_id, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS var, round(median(value), 6) AS med FROM samples GROUP BY rec_id")
def list_statistics(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("rec_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 4).alias("var"), F.round(F.median("value"), 6).alias("med"))


@query("agg9_weighted_statistics", f"WITH {SAMPLES} SELECT event_type AS comp, round(sum(g), 6) AS occ, round(sum(g * value), 5) AS first, round(sum(g * value * value), 4) AS second FROM (SELECT *, 1.0 / (idx + 1) AS g FROM samples) GROUP BY event_type")
def weighted_statistics(spark, sf_dir):
    g = 1.0 / (F.col("idx") + 1)
    return samples(spark, sf_dir).groupBy(F.col("event_type").alias("comp")).agg(F.round(F.sum(g), 6).alias("occ"), F.round(F.sum(g * F.col("value")), 5).alias("first"), F.round(F.sum(g * F.col("value") * F.col("value")), 4).alias("second"))


@query("agg10_merged_statistics", f"WITH {SAMPLES} SELECT count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 5) AS var FROM samples")
def merged_statistics(spark, sf_dir):
    """(n, mean, variance) of records, merged by the pairwise formula."""
    per = samples(spark, sf_dir).groupBy("rec_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / n
    return per.agg(n.alias("n"), F.round(mean, 6).alias("mean"), F.round(F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / n - mean * mean, 5).alias("var"))


@query("agg13_agg15_energy_peak", f"WITH {SAMPLES} SELECT rec_id, round(sum(abs(value)), 6) AS energy, round(max(abs(value)), 6) AS peak, max(abs(value)) > 100 AS saturated FROM samples GROUP BY rec_id")
def energy_peak(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("rec_id").agg(F.round(F.sum(F.abs("value")), 6).alias("energy"), F.round(F.max(F.abs("value")), 6).alias("peak"), (F.max(F.abs("value")) > 100).alias("saturated"))


@query("agg16_levels_and_snr", f"""WITH {SAMPLES}, t AS (SELECT *, exp(avg(ln(value + 1)) OVER (PARTITION BY rec_id)) AS threshold FROM samples)
SELECT rec_id, round(any_value(threshold), 6) AS threshold, round(avg(value) FILTER (value > threshold), 6) AS speech, round(exp(avg(ln(value + 1)) FILTER (value <= threshold)), 6) AS silence,
  round(10 * log10(avg(value) FILTER (value > threshold) / exp(avg(ln(value + 1)) FILTER (value <= threshold))), 6) AS snr FROM t GROUP BY rec_id""")
def levels_and_snr(spark, sf_dir):
    threshold = F.exp(F.avg(F.log(F.col("value") + 1)).over(W.partitionBy("rec_id")))
    loud = F.col("value") > F.col("threshold")
    speech, silence = F.avg(F.when(loud, F.col("value"))), F.exp(F.avg(F.when(~loud, F.log(F.col("value") + 1))))
    out = samples(spark, sf_dir).withColumn("threshold", threshold).groupBy("rec_id").agg(F.first("threshold").alias("threshold"), speech.alias("speech"), silence.alias("silence"))
    return out.select("rec_id", *[F.round(c, 6).alias(c) for c in ("threshold", "speech", "silence")], F.round(10 * F.log10(F.col("speech") / F.col("silence")), 6).alias("snr"))


_PITCH = "pitches AS (SELECT rec_id, idx, CASE WHEN value BETWEEN 20 AND 120 THEN value ELSE -1 END AS pitch FROM samples)"


def _pitches(spark, sf_dir):
    return samples(spark, sf_dir).select("rec_id", "idx", C.in_range(F.col("value"), 20.0, 120.0).alias("pitch"))


@query("flt5_pitch_clamp", f"WITH {SAMPLES}, {_PITCH} SELECT rec_id, idx, round(pitch, 6) AS pitch FROM pitches")
def pitch_clamp(spark, sf_dir):
    return _pitches(spark, sf_dir).select("rec_id", "idx", F.round("pitch", 6).alias("pitch"))


@query("agg17_flt4_voiced_segments", f"""WITH {SAMPLES}, {_PITCH}, s AS (SELECT rec_id, idx // 5 AS seg_id, count(*) FILTER (pitch > 0) / count(*)::DOUBLE AS rate, avg(pitch) FILTER (pitch > 0) AS mu, stddev_pop(pitch) FILTER (pitch > 0) AS sigma FROM pitches GROUP BY ALL)
SELECT rec_id, seg_id, round(rate, 6) AS rate, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM s WHERE rate >= 0.3 AND mu BETWEEN 25 AND 100 AND sigma <= 30""")
def voiced_segments(spark, sf_dir):
    """Bounds are compared with moments taken in the order of the samples: values of two decimals often lie on them."""
    heard = F.transform(F.array_sort(F.collect_list(F.when(F.col("pitch") > 0, F.struct("idx", "pitch")))), lambda c: c["pitch"])
    per = _pitches(spark, sf_dir).groupBy("rec_id", F.floor(F.col("idx") / 5).alias("seg_id")).agg(F.count("*").alias("n"), heard.alias("x"))
    per = per.filter(F.size("x") > 0).withColumn("sigma", V.running_deviation(F.col("x"))).withColumn("mu", V.quotient(V.total(F.col("x")), F.size("x"))).withColumn("rate", F.size("x") / F.col("n"))
    return per.filter((F.col("rate") >= 0.3) & F.col("mu").between(25, 100) & (F.col("sigma") <= 30)).select("rec_id", "seg_id", *[F.round(c, 6).alias(c) for c in ("rate", "mu", "sigma")])


@query("flt11_sufficient_calibration", f"WITH {SAMPLES} SELECT rec_id, count(*) AS n FROM samples GROUP BY rec_id HAVING count(*) * 3.0 >= 30")
def sufficient(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("rec_id").agg(F.count("*").alias("n")).filter(F.col("n") * 3.0 >= 30)


@query("scl14_gender", f"WITH {SAMPLES}, g AS (SELECT rec_id, avg(value) AS p FROM samples GROUP BY rec_id), k AS (SELECT rec_id, CASE WHEN p < 40 THEN 1 WHEN p > 60 THEN 2 ELSE 0 END AS gender FROM g) SELECT a.gender AS a, b.gender AS b, CASE WHEN a.gender = 0 OR b.gender = 0 THEN -1 WHEN a.gender = b.gender THEN 1 ELSE 0 END AS decision, count(*) AS n FROM k a JOIN k b ON b.rec_id = a.rec_id + 1 GROUP BY ALL")
def genders(spark, sf_dir):
    g = samples(spark, sf_dir).groupBy("rec_id").agg(F.avg("value").alias("p")).select("rec_id", C.gender(F.col("p"), 40.0, 60.0).alias("gender"))
    a, b = g.select(F.col("rec_id").alias("i"), F.col("gender").alias("a")), g.select((F.col("rec_id") - 1).alias("i"), F.col("gender").alias("b"))
    return a.join(b, "i").withColumn("decision", C.gender_decision(F.col("a"), F.col("b"))).groupBy("a", "b", "decision").agg(F.count("*").alias("n"))


@query("agg18_weighted_histogram", f"WITH {SAMPLES} SELECT event_type AS symbol, round(sum(value) / (SELECT sum(value) FROM samples), 8) AS share FROM samples GROUP BY event_type")
def weighted_histogram(spark, sf_dir):
    s = samples(spark, sf_dir)
    per = s.groupBy(F.col("event_type").alias("symbol")).agg(F.sum("value").alias("w"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("w").alias("t")))).select("symbol", F.round(F.col("w") / F.col("t"), 8).alias("share"))


@query("agg19_sta24_transitions", f"WITH {SAMPLES}, t AS (SELECT event_type AS q, lead(event_type) {_O} AS q_next FROM samples) SELECT q, q_next, count(*) AS n FROM t WHERE q_next IS NOT NULL GROUP BY ALL")
def transitions(spark, sf_dir):
    t = samples(spark, sf_dir).select(F.col("event_type").alias("q"), F.lead("event_type").over(S.sample_order()).alias("q_next"))
    return t.filter("q_next is not null").groupBy("q", "q_next").agg(F.count("*").alias("n"))


@query("sta29_packed_alignment", f"WITH {SAMPLES} SELECT rec_id, string_agg(event_type, ' ' ORDER BY idx) AS packed FROM samples GROUP BY rec_id")
def packed_alignment(spark, sf_dir):
    listed = F.array_sort(F.collect_list(F.struct("idx", "event_type")))
    return samples(spark, sf_dir).groupBy("rec_id").agg(F.concat_ws(" ", F.transform(listed, lambda c: c["event_type"])).alias("packed"))


@query("sig18_energy_threshold", f"WITH {SAMPLES} SELECT rec_id, round(avg(abs(value)), 6) AS threshold FROM samples GROUP BY rec_id")
def energy_threshold(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("rec_id").agg(F.round(F.avg(F.abs("value")), 6).alias("threshold"))


@query(
    "sta13_anderson_darling",
    f"""WITH {SAMPLES}, z AS (SELECT rec_id, (value - avg(value) OVER (PARTITION BY rec_id)) / stddev_samp(value) OVER (PARTITION BY rec_id) AS z FROM samples),
t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
p AS (SELECT rec_id, z, CASE WHEN z >= 0 THEN 1 - q ELSE q END AS p FROM (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS q FROM t)),
r AS (SELECT rec_id, p, row_number() OVER (PARTITION BY rec_id ORDER BY p) AS i, row_number() OVER (PARTITION BY rec_id ORDER BY p DESC) AS j, count(*) OVER (PARTITION BY rec_id) AS n FROM p)
SELECT rec_id, n, round((-n - sum((2 * i - 1) * ln(p) + (2 * j - 1) * ln(1 - p)) / n) * (1 + 0.75 / n + 2.25 / (n * n)), 4) AS a2 FROM r GROUP BY rec_id, n HAVING n >= 5""",
)
def anderson_darling(spark, sf_dir):
    """A squared with the correction for small samples; both tails' ranks come from the ordered probabilities."""
    w = W.partitionBy("rec_id")
    s = samples(spark, sf_dir).withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w)).withColumn("p", C.normal_cdf(F.col("z")))
    s = s.withColumn("i", F.row_number().over(w.orderBy("p"))).withColumn("j", F.row_number().over(w.orderBy(F.desc("p"))))
    per = s.groupBy("rec_id").agg(F.count("*").alias("n"), F.sum((2 * F.col("i") - 1) * F.log("p") + (2 * F.col("j") - 1) * F.log(1 - F.col("p"))).alias("t"))
    n = F.col("n")
    return per.filter("n >= 5").select("rec_id", "n", F.round((-n - F.col("t") / n) * (1 + 0.75 / n + 2.25 / (n * n)), 4).alias("a2"))


@query("src18_sine_generator", "SELECT i, round(0.3 * (sin(2 * pi() * 440 * i / 8000.0) + sin(2 * pi() * 1000 * i / 8000.0)), 9) + 0.0 AS value FROM range(2000) t(i)")
def sine_generator(spark, sf_dir):
    from cadenza.sources.signals import sine

    return sine(spark, 8000, 2000, [440.0, 1000.0]).select(F.col("idx").alias("i"), (F.round("value", 9) + F.lit(0.0)).alias("value"))


@query("src19_constant_generator", "SELECT i, 0.3::DOUBLE AS value FROM range(500) t(i)")
def constant_generator(spark, sf_dir):
    from cadenza.sources.signals import constant

    return constant(spark, 500).select(F.col("idx").alias("i"), "value")


@query("src25_battery", "SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 50 ELSE s_nationkey / 25.0 * 100 END::DOUBLE AS battery FROM supplier")
def battery(spark, sf_dir):
    level = F.when(F.col("s_nationkey") % 5 == 0, -1).otherwise(F.col("s_nationkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.battery(level, F.lit(25)).alias("battery"))


@query("src24_location_choice", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN value * 2 END, -1) AS latitude FROM events")
def location_choice(spark, sf_dir):
    gps, network = F.when(F.col("event_id") % 3 == 0, F.col("value")), F.when(F.col("event_id") % 2 == 0, F.col("value") * 2)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(gps, network, F.lit(-1.0)).alias("latitude"))


@query("sig7_mel_scale", "SELECT o_orderkey, round(1127 * ln(1 + o_totalprice / 700), 6) AS mel, round(700 * (exp(1127 * ln(1 + o_totalprice / 700) / 1127) - 1), 4) AS back FROM orders")
def mel_scale(spark, sf_dir):
    mel = C.hertz_to_mel(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(mel, 6).alias("mel"), F.round(C.mel_to_hertz(mel), 4).alias("back"))


@query("scl15_clock_formats", "SELECT event_id, strftime(ts, '%Y/%m/%d') AS date, strftime(ts, '%H:%M') AS time, strftime(ts, '%Y.%m.%d.%H.%M.%S') || '.' || lpad(((date_part('microsecond', ts) // 1000) % 1000)::VARCHAR, 3, '0') AS stamp FROM events")
def clock_formats(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *[C.clock(F.col("ts"), c).alias(c) for c in ("date", "time", "stamp")])


@query("scl19_hour_gate", "SELECT event_id FROM events WHERE hour(ts) BETWEEN 9 AND 20")
def hour_gate(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.hour("ts").between(9, 20)).select("event_id")


@query("sig8_vtln_warp", "SELECT o_orderkey, round(CASE WHEN f <= 1000 THEN f * 1.1 WHEN f < 3000 THEN 1100 + (f - 1000) * 0.95 ELSE f END, 6) AS warped FROM (SELECT o_orderkey, o_totalprice / 50 AS f FROM orders)")
def vtln(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(C.vtln_warp(F.col("o_totalprice") / 50, 1000.0, 3000.0, 1.1, 1e9), 6).alias("warped"))


@query("snk7_spk9_diary_by_date", f"WITH {DIARY} SELECT _id, time, n, percentage FROM diary WHERE date = '1996/01/02' ORDER BY time")
def diary_by_date(spark, sf_dir):
    return diary(spark, sf_dir).filter(F.col("date") == "1996/01/02").orderBy("time").select("_id", "time", "n", "percentage")


@query("lim1_recent_tests", f"WITH {DIARY} SELECT _id, time, date, n FROM diary ORDER BY time DESC, _id LIMIT 10")
def recent_tests(spark, sf_dir):
    """The feature is the ten most recent rows."""
    return diary(spark, sf_dir).orderBy(F.desc("time"), "_id").limit(10).select("_id", "time", "date", "n")


@query("set1_sort1_diary_dates", f"WITH {DIARY} SELECT date, min(time) AS first FROM diary GROUP BY date ORDER BY first")
def diary_dates(spark, sf_dir):
    return diary(spark, sf_dir).groupBy("date").agg(F.min("time").alias("first")).orderBy("first")


@query("agg24_speech_percentage", "SELECT l_suppkey AS rec_id, round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS percentage FROM lineitem GROUP BY l_suppkey")
def speech_percentage(spark, sf_dir):
    own = F.sum((F.col("l_returnflag") == "R").cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rec_id")).agg(F.round(100.0 * own / F.count("*"), 6).alias("percentage"))


@query("jn1_positional_join", f"WITH {SAMPLES}, m AS (SELECT label::BIGINT AS rec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding[1]::DOUBLE AS e FROM embeddings) SELECT m.rec_id, m.idx, round(e, 6) + 0.0 AS e, round(value, 6) AS value FROM m JOIN samples s ON s.rec_id = m.rec_id AND s.idx = m.idx")
def positional_join(spark, sf_dir):
    f = frames(spark, sf_dir).select(F.col("rec_id").cast("long").alias("rec_id"), F.col("frame_idx").alias("idx"), r6(F.element_at("x", 1)).alias("e"))
    return f.join(samples(spark, sf_dir).select("rec_id", "idx", F.round("value", 6).alias("value")), ["rec_id", "idx"])


@query("jn2_flt2_label_filter", "SELECT d.doc_id, quality FROM documents d JOIN labels l USING (doc_id) WHERE quality NOT IN (0)")
def label_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").filter(~F.col("quality").isin(0)).select("doc_id", "quality")
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id")


@query("jn7_device_thresholds", "SELECT c_custkey, coalesce(same, 15.6)::DOUBLE AS same, coalesce(diff, 21.6)::DOUBLE AS diff FROM customer LEFT JOIN (VALUES ('BUILDING', 's3', 16.0, 21.0), ('MACHINERY', 'nexus_4', 17.0, 22.0)) t(seg, phone, same, diff) ON c_mktsegment = seg")
def device_lookup(spark, sf_dir):
    phone = F.when(F.col("c_mktsegment") == "BUILDING", "s3").when(F.col("c_mktsegment") == "MACHINERY", "nexus_4")
    return P.device_thresholds(table(spark, sf_dir, "customer").select("c_custkey", phone.alias("phone")), "phone").select("c_custkey", "same", "diff")


@query("jn8_file_pairing", "SELECT url AS src, 'out/' || regexp_extract(url, '[^/]*$') AS dst FROM pages")
def file_pairing(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("url").alias("src"), F.concat_ws("/", F.lit("out"), F.regexp_extract("url", "[^/]*$", 0)).alias("dst"))


@query("set4_membership", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')")
def membership(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(~F.col("event_type").isin("click", "view")).select("event_id")


@query("sort3_cluster_ranking", "SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label")
def cluster_ranking(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


_SEGS = f"""{FRAMES}, segs AS (SELECT rec_id AS speaker, frame_idx // 4 AS seg_id, k, sum(v) AS v FROM cells GROUP BY ALL)"""


def _segs(spark, sf_dir):
    sums = frames(spark, sf_dir).select(F.col("rec_id").alias("speaker"), F.floor(F.col("frame_idx") / 4).alias("seg_id"), F.posexplode("x").alias("k", "v")).groupBy("speaker", "seg_id", "k").agg(F.sum("v").alias("v"))
    return sums.groupBy("speaker", "seg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("s"))


@query("jn4_lim6_symmetric_calibration", f"""WITH {_SEGS}, u AS (SELECT speaker, seg_id, k, v / sqrt(sum(v * v) OVER (PARTITION BY speaker, seg_id)) AS v FROM segs WHERE seg_id < 10)
SELECT a.speaker AS a_speaker, b.speaker AS b_speaker, a.seg_id AS a_seg_id, b.seg_id AS b_seg_id, CASE WHEN a.speaker = b.speaker THEN 'self' ELSE 'other' END AS kind, round(degrees(acos(greatest(-1, least(1, sum(a.v * b.v))))), 5) AS dist
FROM u a JOIN u b ON a.k = b.k AND (a.speaker <> b.speaker OR a.seg_id <> b.seg_id) GROUP BY ALL""")
def symmetric_calibration(spark, sf_dir):
    d = P.calibration_distances(_segs(spark, sf_dir).withColumn("seg_sec", F.lit(6)))
    return d.select("a_speaker", "b_speaker", "a_seg_id", "b_seg_id", "kind", F.round("dist", 5).alias("dist"))


@query("jn3_asymmetric_calibration", f"""WITH {FRAMES}, pre AS (SELECT rec_id AS a, k, avg(v) AS p FROM cells WHERE frame_idx < 12 GROUP BY ALL), segs AS (SELECT rec_id AS c, frame_idx // 4 AS seg_id, k, sum(v) AS v FROM cells GROUP BY ALL)
SELECT a, c, seg_id, CASE WHEN a = c THEN 'self' ELSE 'other' END AS kind, round(degrees(acos(sum(p * v) / (sqrt(sum(p * p)) * sqrt(sum(v * v))))), 5) AS dist FROM pre JOIN segs USING (k) GROUP BY ALL""")
def asymmetric_calibration(spark, sf_dir):
    """The prefix of each speaker against every segment of every speaker."""
    from cadenza.functions import vectors as V
    from cadenza.operators.models import class_means

    pre = class_means(frames(spark, sf_dir).filter("frame_idx < 12"), "rec_id").select(F.col("id").alias("a"), F.col("m"))
    segs = _segs(spark, sf_dir).select(F.col("speaker").alias("c"), "seg_id", "s")
    pairs = P.every_pair(segs, pre, [])
    return pairs.select("a", "c", "seg_id", F.when(F.col("a") == F.col("c"), "self").otherwise("other").alias("kind"), F.round(V.angle(F.col("m"), F.col("s")), 5).alias("dist"))


VOICE = P.Voice(0.0, 0.0, 1e9, 1e9, 40.0, 60.0)


def _listed(spark, sf_dir):
    segs = _segs(spark, sf_dir).withColumn("n", F.lit(4)).withColumn("pitch", 30.0 + 10 * (F.col("seg_id") % 5)).withColumnRenamed("speaker", "rec_id")
    return P._ordered(segs)


@query("spk3_spk4_count_speakers")
def count_speakers(spark, sf_dir):
    merged = P.merge_neighbours(_listed(spark, sf_dir), 70.0, VOICE)
    return P.count_speakers(merged, 75.0, 85.0, VOICE)


@query("spk5_count_with_owner")
def count_with_owner(spark, sf_dir):
    owner = _segs(spark, sf_dir).filter("speaker = 0 and seg_id = 0").select("s", F.lit(35.0).alias("pitch"))
    return P.count_with_owner(_listed(spark, sf_dir), owner, (75.0, 85.0), (75.0, 85.0), VOICE)
