"""Every registered query of the numbered operators, and the pipeline, on small odd tables against plain Python.

The tables have repeated ids, missing values in every column, equal and near copies, a text without a place to cut, and columns whose
names clash with those that the operators add or use.
"""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from cadenza.llm.fingerprint import PARAGRAPH
from cadenza.llm.queries import QUERIES
from cadenza.llm.token_counts import load_tokenizer
from tests.llm.conftest import made_texts
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_mixing import water
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_vector_search import exact
from tests.llm.test_warc import PAGES
from tests.llm.test_warc import brute as archives

CLASH = ["id", "h", "key", "chunk", "tie", "n_lines", "n_dropped", "line_owner", "mix_copies", "row_key", "member", "n_tokens", "ids", "decoded", "encoded_text", "component_id"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return len(WORD.findall(text or ""))


@pytest.fixture(scope="module")
def rows():
    texts = made_texts(90, seed=21)
    base = "the house of the old man was near the river and the people said that it would be good to go there when the winter came again ".split()
    long = [" ".join(base[(i * 7 + j) % len(base)] + ("" if j % 9 else str(i)) for j in range(120)) for i in range(6)]
    near = [t.replace("river", f"stream{i}", 1) for i, t in enumerate(long)]
    rest = [*long, *near, long[0], "ab" * 30_000, "\n" * 50, "x" * 39 + "\n" + "y" * 40]
    out = [(i * 2, t, f"s{i % 3}") for i, t in enumerate(texts + rest)]
    out += [(4, "another text under a repeated id " * 5, "s1"), (0, texts[0], "s0"), (None, long[1], None), (None, None, "s2"), (7, "tab\there", None)]
    return [(i, t, None if i == 8 else "en", s, None if t is None else len(t)) for i, t, s in out]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, key string").write.parquet(f"{folder}/pages.parquet")
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist(), "clash") for i, v in enumerate(rng.standard_normal((120, 8)))] + [(500, None, "x"), (550, [0.0] * 8, "x")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank string").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def got(spark, sf_dir, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, sf_dir).collect()), key=str)


def test_op1(spark, sf_dir, rows):
    by = Counter()
    for _, t, _, s, _ in rows:
        by[s] += words(t)
    want, found = water(dict(by), (5, 2, 1), 1.5, 2), QUERIES["op1_mixing_to_target_weights"](spark, sf_dir).collect()
    assert sorted(((r.doc_id, r["size"]) for r in found), key=str) == sorted(((i, words(t)) for i, t, *_ in rows), key=str)
    assert all(any(abs(r.target - want[s]) < 1e-6 and r.source_size == by[s] for s in by) and r.taken <= 2 * r["size"] for r in found)
    assert abs(sum(r.taken for r in found) - sum(want.values())) <= len(by) * max(words(t) for _, t, *_ in rows)


def test_op2(spark, sf_dir, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = [(i, len(ids), ids, True) for i, t, *_ in rows for ids in [library.encode(t or "")]]
    assert got(spark, sf_dir, "op2_sentencepiece", "doc_id", "n_pieces", "ids", "same_text") == sorted(want, key=str)


def test_op3(spark, sf_dir):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.vec_id < 500]
    want = exact(table, [0, 50, 100], 5)
    found = got(spark, sf_dir, "op3_nearest_neighbours", "query_id", "rank", "vec_id", "score")
    assert len(found) == 15
    hits = sum(v in {i for i, _ in want[q]} for q, _, v, _ in found)
    assert hits >= 13 and all(abs(s - dict(want[q]).get(v, s)) < 1e-12 for q, _, v, s in found)


def test_op4(spark, sf_dir, rows):
    order = sorted({(i is None, -(i or 0)) for i, *_ in rows})
    place = {k: n for n, k in enumerate(order)}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(place[(i is None, -(i or 0))], []).append((i, t or ""))
    found = QUERIES["op4_document_fingerprints"](spark, sf_dir).collect()
    assert len(found) == len(rows)
    cut = lambda t: Counter(re.split(PARAGRAPH, t))
    cosine = lambda a, b: sum(a[k] * b[k] for k in a) / np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    seen, errors, single = {}, [], {g[0][0]: g[0][1] for g in groups.values() if len(g) == 1}
    by_text = {}
    for r in found:
        if r.doc_id not in single:
            continue
        n = place[(r.doc_id is None, -(r.doc_id or 0))]
        after = groups[(n + 1) % len(groups)]
        t = single[r.doc_id]
        assert r.n_chars == len(t) and seen.setdefault(t, r.fingerprint) == r.fingerprint
        by_text[r.fingerprint] = t
        if len(after) == 1:
            half = len(t) // 2
            edited = t[: len(t) - half] + after[0][1][:half]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            errors += [abs(r.near_edited - cosine(cut(t), cut(edited))), abs(r.near_next - cosine(cut(t), cut(after[0][1])))]
    assert len(by_text) == len(set(by_text.values())) == len(set(single.values()))
    assert len(errors) > 100 and np.sqrt(np.mean(np.square(errors))) < 0.08


def test_op5(spark, sf_dir, rows):
    assert got(spark, sf_dir, "op5_ngram_jaccard_join", "doc_id", "n_shingles", "component_id") == components([(i, t) for i, t, *_ in rows], 3, 90, 100)


def test_op6(spark, sf_dir, rows):
    encode = load_tokenizer(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, *_ in rows for ids in [[*encode([t or ""])[0], 2]]]
    found = QUERIES["op6_token_files"](spark, sf_dir).orderBy("start").collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=str) == sorted(want, key=str)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert [r.doc_id for r in found] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))


def test_op7(spark, sf_dir, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = [(i, len((t or "").encode()), n, n > 4096) for i, t, *_ in rows for n in [len(library.encode(t or ""))]]
    assert got(spark, sf_dir, "op7_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)


def test_op8(spark, sf_dir, rows):
    want = sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in lines([(i, t) for i, t, *_ in rows])), key=str)
    assert got(spark, sf_dir, "op8_line_dedup", "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_op9(spark, sf_dir):
    found = QUERIES["op9_language_id"](spark, sf_dir).collect()
    assert len(found) == len(PAGES) and all(0 <= r.confidence <= 1 + 1e-9 for r in found)
    assert all(not r.accepted for r in found if r.page_id in (3, 4))


def test_op10(spark, sf_dir):
    assert got(spark, sf_dir, "op10_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == archives(PAGES)


def test_pipeline(spark, sf_dir, rows):
    """Each stage on its own input, then run() as a whole."""
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = docs.collect(), stage(spark, docs, sf_dir).cache()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert kept.columns == docs.columns and all(r[c] == "clash" for r in kept.collect() for c in CLASH)
        seen[name], docs = (before, kept.collect()), kept
    before, after = seen["language"]
    assert not [r for r in after if not (r.text or "").strip()]  # rows without an id as well
    assert sum(r.text.startswith("the house") for r in after) == sum((r.text or "").startswith("the house") for r in before)
    before, after = seen["line dedup"]
    want = Counter((i, t) for i, _, n, t in lines([(r.doc_id, r.text) for r in before]) if n == 0 or t.strip())
    assert Counter((r.doc_id, r.text) for r in after) == want
    before, after = seen["near duplicates"]
    # Rows of one id are one row for brute force when they get ids of their own, in the order of their ids, none last.
    ranked = sorted(range(len(before)), key=lambda n: (before[n].doc_id is None, before[n].doc_id or 0))
    group = {i: c for i, _, c in components([(n, before[row].text) for n, row in enumerate(ranked)], 5, 8, 10)}
    left = Counter((r.doc_id, r.text) for r in after)
    for c in set(group.values()):
        members = [before[ranked[n]] for n in group if group[n] == c]
        stay = [r for r in members if left[(r.doc_id, r.text)]]
        assert len({(r.doc_id, r.text) for r in stay}) == 1 and left[(stay[0].doc_id, stay[0].text)] == 1
        assert stay[0].doc_id == min((r.doc_id for r in members if r.doc_id is not None), default=None)
    before, after = seen["mixing"]
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    sizes, have = Counter(), Counter()
    for r in before:
        sizes[r.source] += words(r.text)
    for r in after:
        have[r.source] += words(r.text)
    for s, target in water(dict(sizes), (5, 2, 1), 1.5, 2).items():
        assert abs(have[s] - target) <= max(words(r.text) for r in before if r.source == s)
    before, after = seen["sentencepiece"]
    assert len(before) == len(after) and all(r.same_text for r in after)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in whole) == Counter((r.doc_id, r.source, tuple(r.ids)) for r in after)


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
