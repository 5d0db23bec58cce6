import inspect

import corpus_pipeline
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_mixing import water


def test_stages_against_plain_python(spark, docs):
    table = docs.selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars")
    columns, kept, seen = table.columns, table, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        before = kept.collect()
        kept = stage(spark, kept, "").cache()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert kept.columns == columns
        seen[name] = (before, kept.collect())
    before, after = seen["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {r.doc_id for r in before if not (r.text or "").strip()}
    before, after = seen["line dedup"]
    want = {i: t for i, _, n, t in lines([(r.doc_id, r.text) for r in before]) if n == 0 or t.strip()}
    assert {r.doc_id: r.text for r in after} == want
    before, after = seen["near duplicates"]
    texts = {}
    for r in before:
        texts.setdefault(r.text, []).append(r.doc_id)
    assert all(min(ids) == i for ids in texts.values() for i in ids if i in {r.doc_id for r in after})
    before, after = seen["mixing"]
    words = lambda rows: {s: sum(len((r.text or "").split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
    have = words(after)
    for s, target in water(words(before), (5, 2, 1), 1.5, 2).items():
        assert abs(have.get(s, 0) - target) <= max(len((r.text or "").split()) for r in before if r.source == s)
    before, after = seen["sentencepiece"]
    assert len(before) == len(after) and all(r.same_text for r in after)
