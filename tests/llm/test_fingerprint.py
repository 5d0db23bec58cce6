import hashlib

from pyspark.sql import functions as F

from cadenza.llm.fingerprint import combined, edited_pairs, fingerprint, likeness, text_form, without


def test_edits_against_brute_force(spark, docs, odd_docs, no_docs):
    for table, chunk in ((docs, 10), (odd_docs, 2), (odd_docs, 2000)):
        rows = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = []
        for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
            h = len(t) // 2
            want.append((i, len(t), t[: len(t) - h] + nxt[:h]))
        got = [(r.id, r.n_chars, r.edited) for r in edited_pairs(table, rows_per_chunk=chunk).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert edited_pairs(no_docs).count() == 0


def test_one_document_follows_itself(spark):
    one = edited_pairs(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert [(r.edited, r.next_fp == r.fp) for r in one] == [("abab", True)]


def test_multiset_algebra(spark):
    rows = [("One a. Two b. Two b.", "Two b. One a. Two b.", "Two b. Two b.", "One a.", "Nine. Ten."), (None, "", "x", "", "y")]
    t = spark.createDataFrame(rows, "a string, b string, c string, d string, e string").select(*[fingerprint(F.col(c)).alias(c) for c in "abcde"])
    first, second = t.select(
        (F.col("a") == F.col("b")).alias("order"),
        (combined(F.col("c"), F.col("d")) == F.col("a")).alias("insert"),
        (without(F.col("a"), F.col("d")) == F.col("c")).alias("delete"),
        likeness(F.col("a"), F.col("b")).alias("same"),
        likeness(F.col("a"), F.col("c")).alias("near"),
        likeness(F.col("a"), F.col("e")).alias("far"),
        F.length(text_form(F.col("a"))).alias("n"),
    ).collect()
    assert first.order and first.insert and first.delete and first.same == 1 and first.near > 0.7 > 0.3 > first.far
    assert second.order and second.n == first.n and second.n % 16 == 0


def test_equal_texts_and_likeness_of_edits(spark, docs):
    pairs = edited_pairs(docs).withColumn("efp", fingerprint(F.col("edited")))
    rows = pairs.select("text", "fp", likeness(F.col("fp"), F.col("efp")).alias("near"), likeness(F.col("fp"), F.col("next_fp")).alias("next")).collect()
    seen = {}
    for r in rows:
        key = hashlib.sha256(r.text.encode()).digest()
        assert seen.setdefault(key, r.fp) == r.fp
        assert 0 <= r.near <= 1 and 0 <= r.next <= 1
    assert sum(r.near for r in rows) > sum(r.next for r in rows)
