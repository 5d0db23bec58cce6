import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cadenza.llm import prefix_trie as module
from cadenza.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string, key string, depth string, n_convs string"


def conversations():
    """Copies, shared beginnings, a chain, missing values; the last columns clash with the result's."""
    r, rows = random.Random(4), []
    say = [("user", "hi"), ("assistant", "hello ü"), ("user", ""), (None, None), ("user", "hi ")]
    for c in range(60):
        for t in range(r.randint(1, 7)):
            rows.append((c, t, *say[r.choice([0, 0, 0, 1, 2, 3, 4])]))
    rows += [(c, t, "user", "the same") for c in range(70, 100) for t in range(3)]
    rows += [(103, t, "user", f"long {t}" * 50) for t in range(75)]  # its source, 100, is absent
    rows += [(104, None, "user", "first"), (104, 0, "user", "second"), (-7, 0, "x", "y"), (None, 0, "user", "nobody's")]
    r.shuffle(rows)
    return rows


def brute(rows, group=5, most=8):
    """All columns of the query's result, in plain Python."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), (role or "", text or "")))
    turns = {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % (most + 1) if group > 1 else 0
        rest = c % group if c >= 0 else -(-c % group)  # the remainder has the sign of c
        paths[c] = tuple(turns.get(c - rest, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(paths[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [True, False])
def test_against_plain_python(spark, monkeypatch, small):
    """Also with small blocks, and with joins as for tables too large to broadcast."""
    if not small:
        monkeypatch.setattr(module, "BLOCK", 4)
        monkeypatch.setattr(module, "IDS", 8)
        monkeypatch.setattr(module, "HOT", 8)
        monkeypatch.setattr(module, "is_small", lambda side: False)
        monkeypatch.setattr(module, "bounded", lambda side: side)
    rows = conversations()
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    assert found(conversation_trie(table, group=5, most_shared=8)) == brute(rows)
    if small:
        assert found(conversation_trie(table)) == brute(rows, group=1)


def test_ties_are_turns_of_their_own(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "user", "b")]
    nodes = {(r.depth, r.n_convs) for r in conversation_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert (0, 3) in nodes and (2, 1) in nodes and (2, 2) in nodes  # 2 and 3 have the same turns in the same order


def test_empty_table(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA), group=5, most_shared=8).count() == 0
