import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import ngram_join
from cadenza.llm.line_dedup import LOWER, UPPER
from cadenza.llm.ngram_join import _levels, ngram_components, signatures

LOW = str.maketrans(UPPER, LOWER)


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 8, 10), (1, 5, 10)])
def test_against_brute_force(spark, docs, k, num, den):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_components(docs, k=k, threshold=(num, den)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, num, den)


def test_near_copies_chain_through_others(spark):
    """A large group of near copies whose ends are far from each other."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(words)
        copy[i % 40 : i % 40 + 1 + i % 3] = [f"c{i}_{j}" for j in range(1 + i % 3)]
        rows.append((i, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_components(table, k=3, threshold=(90, 100)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_groups_of_random_edits(spark, k, num, den):
    """Copies of three bases with up to a fifth of their words changed, dropped or doubled, some edits in common."""
    r = np.random.default_rng(17)
    rows = []
    for i in range(240):
        base = [f"b{i % 3}_{j % 90}" for j in range(150 + i % 3)]
        edits = int(r.integers(0, 1 + (30 if i % 4 == 0 else 6)))
        for _ in range(edits):
            at, kind = int(r.integers(0, len(base))), int(r.integers(0, 4))
            base[at : at + 1] = [[f"new{r.integers(0, 400)}"], [], [base[at], base[at]], [f"often{at // 40}"]][kind]
        rows.append((i, " ".join(base)))
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, threshold=(num, den)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, num, den)
    assert 1 < len({r.component_id for r in got}) < 240


def test_odd_rows(spark, odd_docs, no_docs):
    got = ngram_components(odd_docs).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], 5, 8, 10)
    assert ngram_components(no_docs).count() == 0


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(5)
    for num, den in ((9, 10), (8, 10), (5, 10)):
        lows, highs = _levels(num, den)
        for _ in range(400):
            n = int(r.integers(1, 80))
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            room = int((1 - num / den) / (1 + num / den) * 2 * n) + 1
            b = np.unique(np.concatenate([a[int(r.integers(0, room + 1)) :], r.integers(0, 2**63, int(r.integers(0, room + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both < len(a) + len(b) - both and both * den >= num * (len(a) + len(b) - both):
                assert Counter(signatures(a, num, den, lows, highs).tolist()) & Counter(signatures(b, num, den, lows, highs).tolist())


@pytest.mark.parametrize("parts", [3, 0])
def test_shared_keys_of_small_packs(parts):
    """Keys that are shared within a pack, across packs, in both ways and not at all; one key is everybody's."""
    r = np.random.default_rng(5)
    texts = [" ".join(["common", *(f"w{i}" for i in r.integers(0, 400, 12)), f"own{n}"]) for n in range(150)]
    tasks = [texts[:60], texts[60:110], texts[110:]]
    rows, sets = [], {}
    for some in tasks:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some)], ["id", "text"])
        for out in ngram_join._packed_rows(1, lambda grams: grams, 7, parts, at_once=90)([batch]):
            rows += out.to_pylist()
    for text in texts:
        (grams,) = [g for _, g in ngram_join.shingle_sets(pa.array([text]), 1)]
        sets[ngram_join._digest(grams) & ngram_join._MASK] = set(grams.tolist())
    holders = Counter(g for grams in sets.values() for g in grams)
    rows.sort(key=lambda x: x["bucket"])
    assert sum(x["bucket"] >= 0 and len(x["owners"]) == 0 for x in rows) > 10
    packed = [pa.RecordBatch.from_pylist(rows[i : i + 9], out.schema) for i in range(0, len(rows), 9)]
    found = [x for b in ngram_join._folded(packed, parts) for x in b.to_pylist()]
    want = {v: sum(holders[g] > 1 for g in grams) for v, grams in sets.items()}
    if parts:
        found.sort(key=lambda x: x["part"])
        counted = ngram_join._summed_counts([pa.RecordBatch.from_pylist(found, ngram_join._COUNTS)])
        assert {x["o"]: x["n"] for b in counted for x in b.to_pylist()} == {v: n for v, n in want.items() if n}
    else:
        assert Counter(x["o"] for x in {(x["sig"], x["o"]): x for x in found}.values()) == Counter({v: n for v, n in want.items() if n})
        assert len({x["sig"] for x in found}) == sum(n > 1 for n in holders.values())
