"""Engine queries on made events where the order of a sum, a zero or a tie decides, against their SQL."""

import datetime
import math
import os

import duckdb
import numpy as np
import pytest

from cadenza.operators import sequence as S
from cadenza.plans import registered

FOUND = registered()
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def events(spark, tmp_path):
    """A function: (user, value) in the order of their times -> folder of tables, its rows scattered over files."""

    def write(rows):
        made = [(i, START + datetime.timedelta(seconds=i), u, "view", float(v), "") for i, (u, v) in enumerate(rows)]
        df = spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        df.selectExpr("event_id", "ts::timestamp_ntz ts", "user_id", "event_type", "value", "props").orderBy((df.event_id * 7919) % 1009).write.parquet(f"{tmp_path}/events.parquet")
        return str(tmp_path)

    return write


def both(spark, folder, name):
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view events as select * from '{os.path.join(folder, 'events.parquet')}/*.parquet'")
    got = FOUND.QUERIES[name](spark, folder)
    want = con.execute(f"select {', '.join(got.columns)} from ({FOUND.ORACLES[name]})").fetchall()
    clean = lambda rows: sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows)
    return clean(map(tuple, got.collect())), clean(want)


def test_cumulative_mean_from_zero(spark, events):
    """The mean of a record that starts with zeros is no divisor; one that falls back to zero gives infinity."""
    got, want = both(spark, events([(1, 0), (1, 0), (1, 4.5), (2, 3), (2, -3), (3, 7.25)]), "win14_cumulative_mean")
    assert got == want and [g[2] for g in got] == ["nan", "nan", 3.0, 1.0, float("-inf"), 1.0]


def test_voiced_segments_on_the_bound(spark, events):
    """Deviations of exactly 30: what the running update gives decides, as in SQL."""
    pairs = [(83.04, 23.04), (23.04, 83.04), (83.62, 23.62), (20, 80), (90, 30), (30, 90), (20.5, 80.52), (500, 500)]
    rows = [(u, v) for u, (a, b) in enumerate(pairs) for v in (a, 500, b, 500, 500)]
    got, want = both(spark, events(rows), "agg17_flt4_voiced_segments")
    assert got == want and [g[0] for g in got] == [3, 4, 5]


def tied(users):
    """Records of made values, one of which is their mean; what the sum in order gives differs from the exact mean in some."""
    r, out = np.random.default_rng(7), []
    for u in range(users):
        v, x = int(r.exponential(5000)) + 100, np.round(r.exponential(5000, 40)).astype(int)
        while (apart := 40 * v - int(x.sum())) != 0:
            i = r.integers(40)
            x[i] = max(0, x[i] + apart)
        out += [(u, float(c) / 100) for c in r.permutation(np.append(x, v))]
    return out


@pytest.mark.parametrize("name", ["sig20_speech_string", "win10_voicing_smoothing", "str7_stream_voicing", "win12_closing_opening", "win15_silence_ends"])
def test_samples_that_are_the_mean(spark, events, name):
    got, want = both(spark, events(tied(30)), name)
    assert got == want


def test_mean_is_added_up_in_order(spark):
    rows = [(u, i, v) for i, (u, v) in enumerate(tied(200))]
    means = {u: np.cumsum([v for w, _, v in rows if w == u])[-1] / 41 for u in range(200)}
    df = spark.createDataFrame([rows[i] for i in np.random.default_rng(1).permutation(len(rows))], "rec_id long, idx long, value double").repartition(16)
    assert all(r["speech"] == int(r["value"] > means[r["rec_id"]]) for r in S.above_mean(df).collect())
