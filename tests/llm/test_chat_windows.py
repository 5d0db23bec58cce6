import random
import re
from collections import defaultdict

import pytest

from cadenza.llm import chat_windows as module
from cadenza.llm.chat_windows import chat_windows, escaped, read_turns, unescaped

SCHEMA = "conv_id long, turn long, role string, text string, block string, text_ string, loss string"
MARKS = ["</s>", "[INST]", "[/INST]", "<\\/s>", "[\\\\INST]", "[", "<", "\\", "/s>", "ü", " word ", "\n", "[INST", "<</s>"]


def conversations():
    """Long and short turns, system turns, marks in texts, ties, missing values, a conversation without an id."""
    r, rows = random.Random(8), []
    for c in range(40):
        for t in range(r.randint(1, 30)):
            role = "system" if t == 0 and c % 3 == 0 else r.choice(["user", "assistant", "assistant", None, "tool[/INST]"])
            text = None if r.random() < 0.05 else "".join(r.choice(MARKS) for _ in range(r.choice([0, 2, 8, 30])))
            rows.append((None if c == 39 else c, t * (1 if c % 2 else 1_000_003) if r.random() < 0.95 else None, role, text))
    rows += [(50, 0, "system", "only " * 40)] + [(51, 1, "assistant", "again")] * 25 + [(52, t, "assistant", "w " * 500) for t in range(3)]
    r.shuffle(rows)
    return rows


def ordered(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    return {c: [(role, text) for _, role, text in sorted(v)] for c, v in by.items()}


def size(turn):
    return len(re.findall(r"[^\x20\x09-\x0D]+", turn[1])) + 3


@pytest.mark.parametrize(("block", "budget", "history"), [(512, 60, 15), (7, 60, 15), (7, 40, 0), (512, 100_000, 50)])
def test_windows(spark, monkeypatch, block, budget, history):
    monkeypatch.setattr(module, "BLOCK", block)
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in conversations()], SCHEMA).repartition(4)
    by = defaultdict(list)
    for r in chat_windows(table, budget=budget, history=history).withColumn("read", read_turns(module.F.col("text"))).orderBy("block", "window").collect():
        by[r.conv_id].append(r)
    want = ordered(conversations())
    assert set(by) == set(want)
    for c, windows in by.items():
        turns, at = want[c], 0
        system = turns[:1] if turns[0][0] == "system" else []
        for k, w in enumerate(windows):
            read = [(t.role, t.text) for t in w.read]
            assert read[w.n_repeated :] == turns[at : at + w.n_new] and len(read) == w.n_repeated + w.n_new
            assert w.n_tokens == sum(map(size, read))
            # The system turn, then the turns right before the new ones, within their tokens.
            old = read[: w.n_repeated]
            if k and system:
                assert old[:1] == system
                old = old[1:]
            assert not old or (old == turns[at - len(old) : at] and sum(map(size, old)) <= history)
            new = [t for t in turns[at : at + w.n_new] if not (at == 0 and [t] == system)]
            assert w.n_tokens <= budget or len(new) <= 1
            if block == 512 and k:  # no more history fits, and the last window could not have had these turns too
                before = at - len(old) - 1
                assert before < len(system) or sum(map(size, old)) + size(turns[before]) > history
            learnt = [module_unescape(w.text[s.begin : s.end]) for s in w.loss]
            assert learnt == [text for role, text in turns[at : at + w.n_new] if role == "assistant" and text]
            at += w.n_new
        assert at == len(turns)
    if budget == 100_000 and block == 512:
        assert all(len(w) == 1 for w in by.values())


def module_unescape(text):
    return re.sub(r"<\\(\\*/s>)", r"<\1", re.sub(r"\[\\(\\*/?INST\])", r"[\1", text))


def test_escapes_are_reversible(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(MARKS) for _ in range(6)) for _ in range(400)]
    F = module.F
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).withColumn("back", unescaped(F.col("e"))).collect()
    assert all(r.back == r.t and not re.search(r"</s>|\[/?INST\]", r.e) for r in rows)
    assert len({r.e for r in rows}) == len(set(texts))


def test_tokens_of_the_caller_and_an_empty_table(spark):
    table = spark.createDataFrame([(1, t, "user", "x", "", "", "") for t in range(10)], SCHEMA)
    windows = chat_windows(table, budget=100, history=0, tokens=module.F.lit(47)).collect()
    assert sorted(w.n_new for w in windows) == [2] * 5 and all(w.n_tokens == 100 for w in windows)
    assert chat_windows(table.filter("false")).count() == 0
    with pytest.raises(ValueError):
        chat_windows(table, budget=10, history=10)
