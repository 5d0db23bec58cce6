import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm.fill_middle import SENTINELS, Machine, checked, cut_texts, fill_in_middle, restored
from cadenza.llm.shingles import text_buffers

PARTS = ["a", "b", "\n", "ü", "日", "😀", "<", "P", ">", "<P", "<S>", "x" * 50, "\n\n"]


def brute(i, text, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+"):
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(unit, text, re.S)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, s, m = SENTINELS
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def test_cuts_of_odd_texts():
    r = random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.choice([0, 1, 5, 40, 300]))) for _ in range(600)] + ["\n" * 3000, "x" * 50_000, "<P>" * 700, "<" * 600 + "P>"]
    raw, offsets = text_buffers(pa.array(texts))
    draws = [np.array([r.randrange(2**32) for _ in texts]) for _ in range(2)]
    for ends, unit in (("\n", r"[^\n]*\n|[^\n]+"), ("", "."), ("\nx", r"[^\nx]*[\nx]|[^\nx]+")):
        found = cut_texts(Machine.of(checked(SENTINELS), ends.encode()), raw, offsets, draws)
        for i, t in enumerate(texts):
            units = re.findall(unit, t, re.S)
            low, high = ("".join(units[: k]) for k in sorted(int(d[i]) % (len(units) + 1) for d in draws))
            want = len(units), sum(t.count(s) for s in SENTINELS), len(low.encode()), len(low), len(high.encode()), len(high)
            assert tuple(int(found[k][i]) for k in ("units", "sentinels", "low_byte", "low_chars", "high_byte", "high_chars")) == want


def test_against_plain_python(spark, docs, odd_docs, no_docs):
    clash = docs.withColumns({c: docs.component_id for c in ("n", "form", "digest", "draw0", "whole_text")})
    marked = spark.createDataFrame([(901, "a <P> b\nc"), (902, "\n"), (903, "one\ntwo"), (None, "one\ntwo"), (904, "<P\n>")], "doc_id long, text string")
    for table, rate, spm in ((clash, 100, 50), (clash, 40, 0), (odd_docs, 100, 100), (marked, 100, 50)):
        found = fill_in_middle(table, rate=rate, spm_rate=spm).withColumn("back", restored_col())
        want = Counter((r.doc_id, r.text or "", *brute(r.doc_id, r.text, rate, spm)) for r in table.collect())
        assert Counter((r.doc_id, r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in found.collect()) == want
    assert set(docs.columns) <= set(fill_in_middle(docs).columns)
    assert fill_in_middle(no_docs).count() == 0


def restored_col():
    from pyspark.sql import functions as F

    return restored(F.col("text"), F.col("form"))


def test_other_sentinels_and_single_characters(spark):
    table = spark.createDataFrame([(i, "häuser am See" * (i % 4)) for i in range(40)], "doc_id long, text string")
    own = ("[[pre.", "[[suf.", "[[mid.")
    found = fill_in_middle(table, sentinels=own, unit_ends="")
    for r in found.collect():
        n, form, prefix, middle, text = brute(r.doc_id, "häuser am See" * (r.doc_id % 4), unit=".")
        for a, b in zip(SENTINELS, own, strict=True):
            text = text.replace(a, b)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.text) == (n, form, prefix, middle, text)


@pytest.mark.parametrize("bad", [("aa", "ab", "c"), ("aba", "x", "y"), ("x", "xy", "z"), ("", "a", "b")])
def test_sentinels_that_could_be_mistaken(bad):
    with pytest.raises(ValueError):
        checked(bad)
