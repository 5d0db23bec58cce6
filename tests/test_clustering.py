import numpy as np
import pytest

from cadenza.operators import clustering as G
from cadenza.operators import models as M


def table(spark, x, keys=None):
    return spark.createDataFrame([(int(keys[i]) if keys is not None else 0, i, v.tolist()) for i, v in enumerate(x)], "rec_id int, frame_idx long, x array<double>")


def test_normality(spark):
    rng = np.random.default_rng(11)
    rows = [("normal", i, float(v)) for i, v in enumerate(rng.standard_normal(4000))] + [("two", i, float(v)) for i, v in enumerate(np.concatenate([rng.normal(-3, 1, 500), rng.normal(3, 1, 500)]))]
    got = {r.rec_id: r.a2 for r in G.anderson_darling(spark.createDataFrame(rows, "rec_id string, idx int, value double")).collect()}
    assert got["normal"] < G.CRITICAL[0.01] < G.CRITICAL[0.0001] < got["two"]


def test_splitting_finds_the_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.5, (80, 2)) for c in ([0, 0], [6, 0], [0, 9])])
    f = table(spark, x)
    at = G.g_means(f, 0.0001)
    assert sorted(np.round(at).tolist()) == [[0, 0], [0, 9], [6, 0]]
    got = G.hierarchical(f, 3, least=50).orderBy("frame_idx").collect()
    labels = [{r.cluster for r in got[i : i + 80]} for i in (0, 80, 160)]
    assert all(len(s) == 1 for s in labels) and len(set.union(*labels)) == 3
    with pytest.raises(ValueError):
        G.hierarchical(f, 2, ranking="none")


def test_nuisance_and_sparse_components(spark):
    rng = np.random.default_rng(6)
    noise = np.array([3.0, 4.0, 0.0]) / 5
    keys = np.repeat([0, 1], 100)
    x = keys[:, None] * np.array([0.0, 0.0, 2.0]) + rng.normal(0, 3, (200, 1)) * noise + rng.normal(0, 0.1, (200, 3))
    f = table(spark, x, keys)
    basis = G.nuisance_basis(f, "rec_id", 1)
    assert abs(abs(basis[0] @ noise) - 1) < 1e-3
    clean = np.array([r.x for r in G.remove_nuisance(f, basis).orderBy("frame_idx").collect()])
    assert np.allclose(clean, x - np.outer(x @ basis[0], basis[0]))
    directions, values = G.sparse_pca(f, 2)
    s = np.linalg.svd(x - x.mean(0))[1]
    assert np.allclose(values, s[:2] ** 2, rtol=1e-3) and np.allclose(directions @ directions.T, np.eye(2), atol=1e-3)


def test_discriminative_update_raises_the_posterior(spark):
    rng = np.random.default_rng(9)
    keys = np.repeat([0, 1], 150)
    x = np.where(keys[:, None] == 0, rng.normal(-1, 1, (300, 2)), rng.normal(1, 1.5, (300, 2)))
    start = [M.Mixture(np.ones(1), np.array([[-0.2, -0.2]]), np.ones((1, 2))), M.Mixture(np.ones(1), np.array([[0.2, 0.2]]), np.ones((1, 2)))]

    def objective(models):
        logs = np.stack([m.score(x)[:, 0] for m in models], 1)
        return (logs[np.arange(300), keys] - np.log(np.exp(logs).sum(1))).sum()

    assert objective(G.mmie(table(spark, x, keys), start, "rec_id")) > objective(start)


def test_sparse_components_of_any_number_of_rows(spark):
    rng = np.random.default_rng(4)
    for n, d in ((5000, 3), (4, 9)):
        x = rng.normal(2, np.arange(1, d + 1), (n, d))
        directions, values = G.sparse_pca(table(spark, x), 2)
        _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
        assert np.allclose(values, s[:2] ** 2, rtol=1e-3) and np.allclose(abs((directions * v[:2]).sum(1)), 1, atol=1e-3)


def test_sparse_components_query_takes_all_frames(spark):
    from cadenza.plans import registered

    sf = "/root/testdata/sf0.001"
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float)
    got = [r.value for r in registered().QUERIES["sta19_sparse_components"](spark, sf).orderBy("i").collect()]
    assert np.allclose(got, np.linalg.svd(x - x.mean(0))[1][:5] ** 2, rtol=1e-6)


def test_discriminative_update_by_segments_against_numpy(spark):
    rng = np.random.default_rng(12)
    keys = np.repeat([0, 1, 2], 80)
    x = rng.normal(keys[:, None] * 0.7, 1.3, (240, 2))
    start = [M.Mixture(np.array([0.4, 0.6]), np.array([[c - 0.5, c], [c + 0.5, c]]) * 0.7, np.full((2, 2), 1.5)) for c in range(3)]
    f = spark.createDataFrame([(int(c), i // 4, v.tolist()) for i, (c, v) in enumerate(zip(keys, x, strict=True))], "rec_id int, seg_id long, x array<double>").repartition(3)
    got = G.mmie(f, start, "rec_id", segment=["seg_id"])
    logs = np.stack([m.score(x) for m in start], 1)
    whole = np.log(np.exp(logs).sum(2))
    share = np.exp(whole.reshape(60, 4, 3).sum(1))
    share = np.repeat(share / share.sum(1, keepdims=True), 4, 0)
    for c, m in enumerate(start):
        own = np.exp(logs[:, c] - whole[:, c, None])
        num, den = own[keys == c], own * share[:, c, None]
        ny, dy = num.sum(0), den.sum(0)
        w = m.weights.copy()
        k = (dy / m.weights).max() - dy / m.weights
        for _ in range(50):
            w = ny + k * w
        assert np.allclose(got[c].weights, w / w.sum()) and not np.allclose(got[c].weights, m.weights)
        big = 2 * dy[:, None]
        mu = (num.T @ x[keys == c] - den.T @ x + big * m.means) / (ny - dy + 2 * dy)[:, None]
        assert np.allclose(got[c].means, mu)


def test_discriminative_query_has_all_classes(spark):
    from cadenza.plans import registered

    got = registered().QUERIES["sta17_mmie"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.c, r.j, r.k) for r in got} == {(c, j, k) for c in range(10) for j in range(2) for k in range(64)}
    assert all(r["var"] > 0 for r in got)


def test_rankings_by_eigenvalues_and_normality(spark):
    rng = np.random.default_rng(3)
    # Equal columns: variance 4 each, eigenvalue 8. Unequal ones: variance 5, eigenvalue 5.
    along = rng.normal(0, 2, 200)
    alike = np.stack([along, along], 1)
    apart = np.stack([rng.normal(40, 5**0.5, 200), rng.normal(0, 0.1, 200)], 1)
    f = table(spark, np.concatenate([alike, apart]))
    for ranking, first in (("largest_eigenvalue", 0), ("eigenvalue_difference", 0), ("covariance", 0), ("variance", 1)):
        got = G.hierarchical(f, 3, ranking, least=50).orderBy("frame_idx").collect()
        parts = [{r.cluster for r in got[:200]}, {r.cluster for r in got[200:]}]
        assert len(parts[first]) == 2 and len(parts[1 - first]) == 1, ranking
    two = np.stack([np.repeat([39.0, 41.0], 100) + rng.normal(0, 0.05, 200), rng.normal(0, 0.01, 200)], 1)
    got = G.hierarchical(table(spark, np.concatenate([alike, two])), 3, "anderson_darling", least=50).orderBy("frame_idx").collect()
    assert len({r.cluster for r in got[:200]}) == 1 and len({r.cluster for r in got[200:]}) == 2


def test_normality_in_ranges_against_numpy(spark):
    from math import erf

    x = np.round(np.random.default_rng(1).gamma(3, 1, 3000), 2)
    found = G.anderson_darling(spark.createDataFrame([(0, float(v)) for v in x], "rec_id int, value double").repartition(4))
    n, p = len(x), np.sort([0.5 * (1 + erf(z / 2**0.5)) for z in (x - x.mean()) / x.std(ddof=1)])
    i = np.arange(1, n + 1)
    a2 = -n - ((2 * i - 1) * (np.log(p) + np.log(1 - p[::-1]))).sum() / n
    assert np.isclose(found.first().a2, a2 * (1 + 0.75 / n + 2.25 / n**2), rtol=1e-5)
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspecdefinition(rec_id" in x.lower()]
    assert windows and all("part#" in x or "here#" in x for x in windows)
