import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm.vector_search import _centroids, _divided, _probes, _rotation, nearest, scan_block


def exact(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(np.isin(ids, queries)):
        score = unit @ unit[q]
        order = np.lexsort((ids, -np.round(score, 12)))
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order if i != q][:k]
    return out


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        floor = best[-1][1] - 1e-9
        hits += sum(r.score >= floor for r in got if r.query_id == q)
        total += len(best)
    return hits / total


def test_recall_and_scores_on_driver_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = nearest(table, F.col("vec_id") % 50 == 0).collect()
    want = exact(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert {r.query_id for r in got} == set(want) and recall(got, want) >= 0.9
    x = dict(rows)
    for r in got:
        a, b = np.array(x[r.query_id], np.float64), np.array(x[r.vec_id], np.float64)
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12 and r.vec_id != r.query_id


def test_copies_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(40)] + [(100, [0.0, 1.0, 0.0]), (150, [0.1, 1.0, 0.0]), (200, None), (201, [0.0, 0.0, 0.0]), (202, [nan, 1.0, 0.0]), (203, [inf, 1.0, 0.0]), (204, [None, 1.0, 0.0]), (250, [1.0]), (300, []), (301, [2.0, 0.0, 1.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = nearest(table, F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {0, 100, 150} and by[0] == [1, 2, 3, 4, 5] and by[100][0] == 150 and len(by[150]) == 5
    assert nearest(table.filter("false"), F.lit(True)).count() == 0
    assert nearest(table.filter("vec_id = 100"), F.lit(True)).count() == 0
    few = nearest(table.filter("vec_id in (100, 150)"), F.lit(True)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(100, 1, 150), (150, 1, 100)]


def test_repeated_ids_with_other_vectors(spark):
    rows = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.02]), (3, [1.0, 0.1]), (4, [1.0, 0.2]), (50, [1.0, 0.3]), (5, [0.0, -1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 4), (3, 3), (4, 5)]


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_where_lists_are_left_out(spark, clusters, capsys):
    """6,000 vectors, 38 lists: without clusters most are probed, with clusters few; recall is at least 0.9 in both cases."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((6000, 32))
    if clusters:
        x = 0.35 * x + rng.standard_normal((clusters, 32))[rng.integers(0, clusters, 6000)]
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ _rotation(32, 7)
    lists = int(np.sqrt(6000) / 2)
    probes = _probes(unit, _centroids(unit, lists, 7), 5, 0.97, 7)
    assert probes < lists and (not clusters or probes < lists / 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    want = exact(rows, list(range(0, 6000, 50)), 5)
    found = recall(got, want)
    with capsys.disabled():
        print(f" recall {found:.3f} with {probes} of {lists} lists")
    assert found >= 0.9 and len({(r.query_id, r["rank"]) for r in got}) == len(got) == 600


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_where_lists_are_cut_again(spark, clusters, capsys):
    """Lists of about 160 vectors, cut until none holds more than 40; a hundred scaled copies of one vector can't be cut."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6000, 32))
    if clusters:
        x = 0.35 * x + rng.standard_normal((clusters, 32))[rng.integers(0, clusters, 6000)]
    x[1000:1100] = x[1000] * np.arange(1, 101)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, most=40).collect()
    found = recall(got, exact(rows, list(range(0, 6000, 50)), 5))
    with capsys.disabled():
        print(f" recall {found:.3f}")
    assert found >= 0.9 and len({(r.query_id, r["rank"]) for r in got}) == len(got) == 600


def test_parts_keep_every_row(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(0 if i < 2900 else 7, i, v.tolist()) for i, v in enumerate(x)]
    cells = spark.createDataFrame(rows, "list long, u long, x array<double>")
    asked = cells.filter("u % 100 = 0").withColumn("nearest", F.lit(True))
    asked = asked.unionByName(asked.withColumns({"list": 7 - F.col("list"), "nearest": F.lit(False)}))
    parts, questions = _divided(cells, asked, 5, 0.97, 7, 200)
    parts, questions = parts.collect(), questions.collect()
    assert sorted(r.u for r in parts) == list(range(3000)) and all(np.allclose(r.x, x[r.u]) for r in parts[::50])
    sizes, held = {}, {}
    for r in parts:
        sizes[r.list] = sizes.get(r.list, 0) + 1
    assert max(sizes.values()) <= 200 and 100 in sizes.values()
    for r in questions:
        held.setdefault(r.u, []).append(r)
    assert len(held) == 30
    for u, some in held.items():
        assert sum(r.nearest for r in some) == 1 and len({r.list for r in some}) == len(some)
        own = next(r.list for r in parts if r.u == u)
        assert next(r.list for r in some if r.nearest) == own and sum(sizes.get(r.list, 0) for r in some) >= 6


def test_scan_drops_few_true_neighbours():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((2000, 64))
    q = v[:20] + 0.3 * rng.standard_normal((20, 64))
    hits = 0
    for row, (ids, _) in zip(q, scan_block(v, q, 6), strict=True):
        hits += len(set(ids) & set(np.argsort(((v - row) ** 2).sum(1))[:6]))
    assert hits >= 0.95 * 120


def test_a_bound_from_elsewhere_drops_only_what_is_farther():
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(300, 64)), rng.normal(size=(20, 64))
    far = ((v[None] - q[:, None]) ** 2).sum(2)
    bounds = np.sort(far, axis=1)[:, 3]
    bounds[0] = np.inf
    bounds[1] = 0.0
    found = scan_block(v, q, 6, bounds)
    assert len(found[0][0]) == 6 and len(found[1][0]) == 0
    for i in range(2, 20):
        assert set(found[i][0]) <= set(np.flatnonzero(far[i] <= bounds[i])) and np.allclose(found[i][1], far[i][found[i][0]])
    assert np.mean([len(f[0]) for f in found[2:]]) > 3.6
