import re

from cadenza.llm.mixing import mix_to_targets, mixed_rows


def water(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | target
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_and_rounding(spark, docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    by = {}
    for r in rows:
        by[r.source] = by.get(r.source, 0) + size[r.doc_id]
    want = water(by, (5, 2, 1), 1.5, 2)
    got = mix_to_targets(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        base = int(r.target / r.source_size + 1e-12) * r["size"]
        assert r.taken - base in (0, r["size"])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(size[r.doc_id] for r in rows if r.source == s)
    again = mix_to_targets(docs.repartition(2)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_expected_copies_are_fair(spark):
    """Over seeds, every item's share of copies is its fraction."""
    data = spark.createDataFrame([(i, "w " * (1 + i % 5), "s" if i < 60 else "t") for i in range(120)], "doc_id long, text string, source string")
    total, target, size = {}, {}, {}
    for seed in range(12):
        for r in mix_to_targets(data, weights=(3, 1), share=1.0, seed=seed).collect():
            total[r.source] = total.get(r.source, 0) + r.copies * (r.doc_id % 5 == 4)
            target[r.source] = r.target / r.source_size
            size[r.source] = 12 * 12
    for s in total:
        assert abs(total[s] / size[s] - target[s]) < 0.15


def test_odd_rows(spark, odd_docs, no_docs):
    got = mix_to_targets(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert len({r.copies for r in got if r.doc_id == 7}) == 1
    assert mix_to_targets(no_docs).count() == 0
    whole = mixed_rows(odd_docs)
    assert whole.columns == odd_docs.columns
    assert whole.count() == sum(r.copies for r in got)
