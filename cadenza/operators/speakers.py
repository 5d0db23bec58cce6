"""Speaker counting: voiced segments of each recording, merged and counted in time order.

A segment is the sum of its feature vectors, its number of frames and its mean pitch, since distances compare mean vectors. The
greedy count depends on the order of segments within a recording, so each recording is one fold over its array of segments
(`aggregate`); recordings are independent and are dealt by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import vectors as V
from cadenza.functions.shared import only_row, rewritten
from cadenza.functions.scalars import gender, gender_decision, in_range

# Distance thresholds in degrees (same, different) by device.
DEVICES = {"moto_x": (13.0, 18.0), "nexus_4": (17.0, 22.0), "s2": (18.0, 25.0), "s3": (16.0, 21.0), "s4": (14.0, 24.0)}
DEFAULT_DEVICE = (15.6, 21.6)
# Segments of each duration in a calibration.
QUOTAS = {1: 80, 2: 40, 3: 25, 4: 20, 5: 16, 6: 10, 7: 10, 8: 10}


@dataclass(frozen=True)
class Voice:
    """Bounds of voiced segments and of genders; all are the caller's choice."""

    rate_lower: float
    mu_lower: float
    mu_upper: float
    sigma_upper: float
    male_upper: float
    female_lower: float


def segments(features: DataFrame, pitches: DataFrame, frames_per_segment: int, voice: Voice) -> DataFrame:
    """rec_id, seg_id, s (sum vector), n, pitch: the voiced segments.

    features (rec_id, frame_idx, x) and pitches (rec_id, frame_idx, pitch; -1 unvoiced) meet by frame. A segment is voiced if its
    share of voiced frames and the mean and deviation of their pitch are within the bounds; NaN is never voiced.
    """
    both = features.join(pitches, ["rec_id", "frame_idx"]).withColumn("seg_id", F.floor(F.col("frame_idx") / frames_per_segment))
    heard = F.when(F.col("pitch") > 0, F.col("pitch"))
    per = both.groupBy("rec_id", "seg_id").agg(F.count("*").alias("n"), (F.count(heard) / F.count("*")).alias("rate"), F.avg(heard).alias("mu"), F.stddev_pop(heard).alias("sigma"))
    voiced = per.filter((F.col("rate") >= voice.rate_lower) & ~F.isnan("mu") & F.col("mu").between(voice.mu_lower, voice.mu_upper) & (F.col("sigma") <= voice.sigma_upper))
    sums = both.select("rec_id", "seg_id", F.posexplode("x").alias("k", "v")).groupBy("rec_id", "seg_id", "k").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("rec_id", "seg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("s"))
    return voiced.join(vectors, ["rec_id", "seg_id"]).select("rec_id", "seg_id", "s", "n", F.col("mu").alias("pitch"))


#: Seconds of the first pitch value and between two of them.
FIRST_TIME, STEP_TIME = 0.032, 0.016


def timed_segments(features: DataFrame, pitches: DataFrame, seconds: float, voice: Voice, clamp: bool = True) -> DataFrame:
    """rec_id, seg_id, s, n, pitch: the voiced segments of fixed duration, by the times of their frames.

    A frame belongs to the segment whose end is the first at or after its time; what follows the last whole segment is left out, and
    so is the last frame of each segment, though it counts in the share of voiced frames. ``clamp`` makes pitches outside the bounds
    unvoiced (a test); without it (a calibration of the owner) only -1 is. Segments have a bounded number of frames.
    """
    time = FIRST_TIME + STEP_TIME * F.col("frame_idx")
    pitch = in_range(F.col("pitch"), voice.mu_lower, voice.mu_upper) if clamp else F.col("pitch")
    placed = pitches.withColumn("seg_id", F.greatest(F.ceil(time / seconds - 1e-9) - 1, F.lit(0))).withColumn("pitch", pitch)
    whole = pitches.groupBy("rec_id").agg(F.floor((FIRST_TIME + STEP_TIME * F.max("frame_idx")) / seconds + 1e-9).alias("segments"))
    ends = placed.groupBy("rec_id", "seg_id").agg(F.max("frame_idx").alias("last"), F.count("*").alias("all"))
    inside = placed.join(ends.join(whole, "rec_id").filter("seg_id < segments"), ["rec_id", "seg_id"]).filter("frame_idx < last")
    heard = F.when(F.col("pitch") != -1, F.col("pitch"))
    per = inside.groupBy("rec_id", "seg_id").agg(F.count("*").alias("n"), (F.count(heard) / F.max("all")).alias("rate"), F.avg(heard).alias("mu"), F.stddev_pop(heard).alias("sigma"))
    voiced = per.filter((F.col("rate") >= voice.rate_lower) & F.col("mu").between(voice.mu_lower, voice.mu_upper) & (F.col("sigma") <= voice.sigma_upper))
    rows = inside.select("rec_id", "frame_idx", "seg_id").join(features, ["rec_id", "frame_idx"]).select("rec_id", "seg_id", F.posexplode("x").alias("k", "v"))
    vectors = rows.groupBy("rec_id", "seg_id", "k").agg(F.sum("v").alias("v")).groupBy("rec_id", "seg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("s"))
    return voiced.join(vectors, ["rec_id", "seg_id"]).select("rec_id", "seg_id", "s", "n", F.col("mu").alias("pitch"))


def owner_model(features: DataFrame, pitches: DataFrame, seconds: float, voice: Voice, least_seconds: float) -> DataFrame:
    """rec_id, s, n, pitch of recordings with enough voiced segments to calibrate their owner; others have no row."""
    segs = timed_segments(features, pitches, seconds, voice, clamp=False)
    enough = segs.groupBy("rec_id").agg(F.count("*").alias("segments"), F.sum("n").alias("n"), F.avg("pitch").alias("pitch")).filter(F.col("segments") * seconds >= least_seconds)
    sums = segs.select("rec_id", F.posexplode("s").alias("k", "v")).groupBy("rec_id", "k").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("s"))
    return enough.join(vectors, "rec_id").select("rec_id", "s", "n", "pitch")


def count_in_recordings(features: DataFrame, pitches: DataFrame, seconds: float, voice: Voice, same: float, different: float) -> DataFrame:
    """rec_id, speakers of every recording, from its features and pitches: segments, neighbours merged, speakers admitted in order."""
    listed = _ordered(timed_segments(features, pitches, seconds, voice))
    found = count_speakers(merge_neighbours(listed, same, voice), same, different, voice)
    return pitches.select("rec_id").distinct().join(found, "rec_id", "left").select("rec_id", F.coalesce("speakers", F.lit(0)).alias("speakers"))


def _apart(a: Column, b: Column) -> Column:
    return V.angle(a["s"], b["s"], clamp=True)


def _decided(a: Column, b: Column, voice: Voice) -> Column:
    return gender_decision(gender(a["pitch"], voice.male_upper, voice.female_lower), gender(b["pitch"], voice.male_upper, voice.female_lower))


def _ordered(table: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("seg_id", "s", F.col("n").cast("double").alias("n"), "pitch")))
    return table.groupBy("rec_id").agg(F.transform(listed, lambda g: F.struct(g["s"].alias("s"), g["n"].alias("n"), g["pitch"].alias("pitch"))).alias("segs"))


def _merged(a: Column, b: Column) -> Column:
    """Both segments' frames together; the pitch is the plain mean of the two."""
    return F.struct(V.add(a["s"], b["s"]).alias("s"), (a["n"] + b["n"]).alias("n"), ((a["pitch"] + b["pitch"]) / 2).alias("pitch"))


def merge_neighbours(listed: DataFrame, same: float, voice: Voice) -> DataFrame:
    """Neighbouring segments within ``same`` degrees and of one gender become one, until no recording has any to merge.

    The table is written between rounds; recordings that are stable aren't touched again.
    """

    def step(done: Column, b: Column) -> Column:
        a = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_merged(a, b)))
        return F.when((F.size(done) > 0) & (_apart(a, b) <= same) & (_decided(a, b, voice) == 1), joined).otherwise(F.concat(done, F.array(b)))

    kind = listed.schema["segs"].dataType.simpleString()
    listed, columns = listed.withColumn("_open", F.lit(True)), listed.columns
    while True:
        merged = F.when(F.col("_open"), F.aggregate("segs", F.array().cast(kind), step)).otherwise(F.col("segs"))
        step_done = listed.withColumn("_next", merged).withColumn("_open", F.size("_next") < F.size("segs")).withColumn("segs", F.col("_next")).drop("_next")
        listed = rewritten(step_done, "segments")
        if listed.filter("_open").isEmpty():
            return listed.select(columns)


def count_speakers(listed: DataFrame, same: float, different: float, voice: Voice) -> DataFrame:
    """rec_id, speakers: segments admitted in order.

    The first segment is a speaker. A segment joins the first speaker within ``same`` degrees and of its gender; it is a new speaker
    if it differs from all (by ``different`` degrees or by gender); otherwise it is undecided and left out. Recordings without segments
    have 0 speakers.
    """
    kind = listed.schema["segs"].dataType.simpleString()

    def step(found: Column, b: Column) -> Column:
        alike = F.transform(found, lambda a: (_apart(a, b) <= same) & (_decided(a, b, voice) == 1))
        unlike = F.forall(found, lambda a: (_decided(a, b, voice) == 0) | (_apart(a, b) >= different))
        first = F.array_position(alike, True)
        joined = F.transform(found, lambda a, i: F.when(i + 1 == first, _merged(a, b)).otherwise(a))
        return F.when(first > 0, joined).when(unlike, F.concat(found, F.array(b))).otherwise(found)

    return listed.withColumn("found", F.aggregate("segs", F.array().cast(kind), step)).select("rec_id", F.size("found").alias("speakers"))


def count_with_owner(listed: DataFrame, owner: DataFrame, semi: tuple[float, float], un: tuple[float, float], voice: Voice) -> DataFrame:
    """rec_id, speakers, percentage: as :func:`count_speakers` with the owner's model (s, n, pitch; one row) as speaker 0.

    The owner is compared by the ``semi`` thresholds, others by ``un``; an owner without a segment of their own isn't counted. The
    percentage is the owner's share of frames, -1 without segments.
    """
    model = F.broadcast(only_row(owner, "owner").select(F.struct("s", F.lit(0.0).alias("n"), "pitch").alias("owner")))
    joined = listed.crossJoin(model)
    kind = listed.schema["segs"].dataType.simpleString()

    def step(found: Column, b: Column) -> Column:
        def bound(i: Column, which: int) -> Column:
            return F.when(i == 0, semi[which]).otherwise(un[which])

        alike = F.transform(found, lambda a, i: (_apart(a, b) <= bound(i, 0)) & (_decided(a, b, voice) == 1))
        unlike = F.forall(F.transform(found, lambda a, i: (_decided(a, b, voice) == 0) | (_apart(a, b) >= bound(i, 1))), lambda x: x)
        first = F.array_position(alike, True)
        merged = F.transform(found, lambda a, i: F.when(i + 1 == first, _merged(a, b)).otherwise(a))
        return F.when(first > 0, merged).when(unlike, F.concat(found, F.array(b))).otherwise(found)

    folded = joined.withColumn("found", F.aggregate("segs", F.array("owner").cast(kind), step))
    own = F.element_at("found", 1)["n"]
    frames = F.aggregate("segs", F.lit(0.0), lambda a, b: a + b["n"])
    return folded.select("rec_id", (F.size("found") - F.when(own > 0, 0).otherwise(1)).alias("speakers"), F.when(frames > 0, 100.0 * own / frames).otherwise(-1.0).alias("percentage"))


def every_pair(a: DataFrame, b: DataFrame, on: list[str], rows: int = 2048) -> DataFrame:
    """Each row of ``a`` with each row of ``b`` that is equal in ``on`` (no columns: with every row); other names must differ.

    The rows of a value are dealt to blocks of about ``rows`` on each side, and a task joins two blocks, so no value is one task's work.
    """

    def blocks(side: DataFrame) -> int:
        return max(1, -(-(side.groupBy(*on).count().agg(F.max("count")).first()[0] or 0) // rows))

    n, m = blocks(a), blocks(b)

    def dealt(side: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        block = F.pmod(F.xxhash64(*side.columns), F.lit(own_blocks)).cast("long")
        return side.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_blocks - 1).cast("long"))))

    return dealt(a, "_a", n, "_b", m).join(dealt(b, "_b", m, "_a", n), [*on, "_a", "_b"]).drop("_a", "_b")


def calibration_distances(segs: DataFrame) -> DataFrame:
    """seg_sec, kind (self or other), dist of every two different segments of one duration, quotas applied.

    segs: speaker, seg_sec, seg_id, s. A speaker has a bounded number of segments (:data:`QUOTAS`), speakers may be many: the segments
    of a duration meet in blocks.
    """
    quota = F.create_map(*[F.lit(x) for pair in QUOTAS.items() for x in pair])
    kept = segs.filter(F.col("seg_id") < quota[F.col("seg_sec")])
    a = kept.select("seg_sec", *[F.col(c).alias(f"a_{c}") for c in ("speaker", "seg_id", "s")])
    b = kept.select("seg_sec", *[F.col(c).alias(f"b_{c}") for c in ("speaker", "seg_id", "s")])
    pairs = every_pair(a, b, ["seg_sec"]).filter("a_speaker <> b_speaker or a_seg_id <> b_seg_id")
    return pairs.select("seg_sec", "a_speaker", "b_speaker", "a_seg_id", "b_seg_id", F.when(F.col("a_speaker") == F.col("b_speaker"), "self").otherwise("other").alias("kind"), V.angle(F.col("a_s"), F.col("b_s"), clamp=True).alias("dist"))


def device_thresholds(phones: DataFrame, phone_col: str) -> DataFrame:
    """phones with same and diff degrees: the device's, or the default."""
    rows = [(k, *v) for k, v in DEVICES.items()]
    table = phones.sparkSession.createDataFrame(rows, f"{phone_col} string, same double, diff double")
    joined = phones.join(F.broadcast(table), phone_col, "left")
    return joined.withColumn("same", F.coalesce("same", F.lit(DEFAULT_DEVICE[0]))).withColumn("diff", F.coalesce("diff", F.lit(DEFAULT_DEVICE[1])))
