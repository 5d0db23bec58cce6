import numpy as np
import pytest

from cadenza.operators import accumulators as A
from cadenza.plans import registered

SF = "/root/testdata/sf0.001"


def brute(groups):
    """(means, covariances, which keep their diagonal only) with numpy."""
    out = []
    for x in groups:
        c = np.cov(x.T, bias=True)
        c[np.diag_indices(len(c))] = np.maximum(np.diag(c), 1e-10)
        singular = len(x) <= x.shape[1] or (x.var(0) == 0).any()
        out.append((x.mean(0), np.diag(np.diag(c)) if singular else c, singular))
    return out


def density(x, mean, cov):
    d = x - mean
    return -0.5 * (np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T) + np.linalg.slogdet(cov)[1] + len(mean) * np.log(2 * np.pi))


def test_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    labels = sorted({r.label for r in rows})
    groups = [np.array([r.embedding for r in rows if r.label == c], np.float64) for c in labels]
    groups[labels.index(0)][:, 0] = 0.0
    model = brute(groups)
    assert model[labels.index(0)][2]
    want = {(c, i): s for c, x in zip(labels, groups, strict=True) for i, s in enumerate(np.stack([density(x, m, v) for m, v, _ in model], 1))}
    found = registered().QUERIES["sta2_full_gaussians_by_class"](spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        scores = want[(r.rec_id, r.frame_idx)]
        assert r.best == scores.argmax() and abs(r.score - scores.max()) <= 1e-4 * max(1.0, abs(scores.max()))


def test_packed_cholesky():
    r = np.random.default_rng(3)
    full = [a @ a.T + 0.1 * np.eye(6) for a in r.standard_normal((5, 6, 6))]
    full.append(np.ones((6, 6)))
    low = np.tril_indices(6)
    factors, whole = A.packed_cholesky(np.array([f[low] for f in full]), 6)
    assert whole.tolist() == [True] * 5 + [False]
    for f, packed in zip(full[:5], factors, strict=False):
        assert np.allclose(np.linalg.cholesky(f)[low], packed)


def test_statistics_add_and_subtract(spark):
    r = np.random.default_rng(4)
    rows = [(None if i % 5 == 0 else i % 3, i, r.standard_normal(3).tolist()) for i in range(60)] + [(1, 61, None)]
    table = spark.createDataFrame(rows, "rec_id int, i int, x array<double>").repartition(4)
    a, b, whole = A.statistics(table.filter("i < 20")), A.statistics(table.filter("i >= 20")), A.statistics(table)

    def listed(t):
        return sorted(((str(x.rec_id), x.n, np.round(x.s + x.q, 9).tolist()) for x in t.collect()))

    assert listed(A.merged(a, b)) == listed(whole) and listed(A.without(whole, a)) == listed(b)
    assert A.without(whole, whole).count() == 0
    none = next(x for x in whole.collect() if x.rec_id is None)
    x = np.array([v for k, _, v in rows if k is None])
    assert none.n == len(x) and np.allclose(none.s, x.sum(0)) and np.allclose(none.q, (x.T @ x)[np.tril_indices(3)])
    assert A.statistics(table.filter("false")).count() == 0


def test_a_model_that_is_too_large(spark, monkeypatch):
    monkeypatch.setattr(A, "MODEL_BYTES", 10)
    with pytest.raises(ValueError):
        A.FullGaussians.of(A.statistics(spark.createDataFrame([(1, [1.0, 2.0])], "rec_id int, x array<double>")))
