"""Every registered query of the engine against its SQL on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from cadenza.plans import registered

SF = "/root/testdata/sf0.001"
FOUND = registered()


def _order(row):
    """Exact values first, so that rows with numbers that differ in the last place still meet."""
    exact = [repr(v) for v in row if not isinstance(v, float)]
    return exact, [math.inf if math.isnan(v) else v for v in row if isinstance(v, float)]


def _rows(columns, rows):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=_order)


def _same(a, b):
    """Equal: the queries round their numbers, and what is left of the last binary place is nothing."""
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1e-13 * max(abs(a), abs(b))
    return repr(a) == repr(b)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(FOUND.ORACLES))
def test_against_sql(spark, duck, name):
    got = FOUND.QUERIES[name](spark, SF)
    cursor = duck.execute(FOUND.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(got.columns) == sorted(columns)
    a, b = _rows(sorted(columns), [r.asDict() for r in got.collect()]), _rows(sorted(columns), want)
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(_same, x, y))]
    assert not off, off[:3]


@pytest.mark.parametrize("name", sorted(set(FOUND.QUERIES) - set(FOUND.ORACLES)))
def test_runs_without_sql(spark, name):
    assert FOUND.QUERIES[name](spark, SF).count() > 0
