import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm.context_coder import BlockError, decode_blocks, encode_blocks
from cadenza.llm.shared import fresh_path
from cadenza.llm.token_counts import load_tokenizer
from cadenza.llm.token_files import Encoder, FileFormatError, pack_file, pack_files, read_token_files, unpack_file, unpack_files, write_token_files

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**32 - 1)), max_size=300), st.integers(1, 70))
def test_blocks_round_trip(ids, block):
    ids = np.array(ids, np.int64)
    blocks = encode_blocks(ids, block)
    assert np.array_equal(decode_blocks(blocks), ids)
    for one in blocks[-1:]:  # a block depends on no other
        assert np.array_equal(decode_blocks([one]), ids[len(ids) - one[0] :])


def test_repetition_is_learnt_and_damage_is_found():
    ids = np.tile(np.random.default_rng(1).integers(0, 50257, 300), 20)
    blocks = encode_blocks(ids)
    assert sum(len(c) for _, _, c in blocks) < 2 * len(ids)
    n, crc, code = blocks[0]
    with pytest.raises(BlockError):
        decode_blocks([(n, crc, code[:5] + bytes([code[5] ^ 255]) + code[6:]), *blocks[1:]])
    raw = pack_file([1, None], [2, 1], np.array([5, 2, 2]))
    assert unpack_file(raw)[0] == [1, None] and unpack_file(raw)[2].tolist() == [5, 2, 2]
    for bad in (raw[:-1], b"x" + raw[1:], raw[:21] + b"\x07" + raw[22:]):
        with pytest.raises((FileFormatError, BlockError)):
            unpack_file(bad)


def test_fewer_bits_than_zlib_and_than_nine():
    """400 whole documents: below 9 bits an id and below zlib at its best on the same blocks of 16-bit ids."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").slice(0, 400)
    ids, _ = Encoder(PATH).column(table.column("text").combine_chunks())
    blocks, at, plain = encode_blocks(ids), 0, 0
    for n, _, _ in blocks:
        plain += len(zlib.compress(ids[at : at + n].astype("<u2").tobytes(), 9))
        at += n
    bits = 8 * sum(len(c) for _, _, c in blocks) / len(ids)
    assert bits < 8 and bits < 0.9 * 8 * plain / len(ids)


def test_words_encode_like_whole_texts():
    encode, encoder = load_tokenizer(PATH), Encoder(PATH)
    rng = np.random.default_rng(3)
    signs = ["a", "Zeit", "é", "ß", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u0085", "1", "'s", "'ll", ".", "-", "漢", "😀", "\x1c", "\x00", "\x7f", "<|endoftext|"]
    texts = ["".join(rng.choice(signs, rng.integers(1, 25))) for _ in range(4000)] + ["", " ", "x" * 5000, "ab " * 3000]
    for some in (texts, [*texts, "a <|endoftext|> b"]):
        ids, bounds = encoder.column(pa.array([*some, None]))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [*encode(some), []]


def test_one_id_in_several_tasks(spark):
    """10,000 rows of one id, and rows without one: several files, order by the hashes of the texts."""
    table = spark.range(12_000).selectExpr("if(id < 10000, 5, if(id < 11000, null, id)) as doc_id", "concat('row ', id, repeat('=', 340)) as text")
    manifest = write_token_files(table, fresh_path(spark, "token-test"), tokenizer=PATH, end_id=2, ids_per_file=5_000)
    assert manifest.filter("documents > 6000").count() == 0 and manifest.select("part").distinct().count() > 3
    got = read_token_files(manifest).orderBy("start").collect()
    want = [r.doc_id for r in table.orderBy("doc_id").collect()]
    ends = np.cumsum([0, *(r.n_tokens for r in got)])
    assert [r.doc_id for r in got] == want and [r.start for r in got] == ends[:-1].tolist()


def test_files_against_brute_force(spark, docs, odd_docs, no_docs):
    encode = load_tokenizer(PATH)
    for table in (docs, odd_docs, no_docs):
        rows = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want, start = [], 0
        for i, t in rows:
            ids = [*encode([t])[0], 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        manifest = write_token_files(table, fresh_path(spark, "token-test"), tokenizer=PATH, end_id=2, ids_per_file=300)
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_files_are_coded_side_by_side_and_stand_alone():
    """Blocks of different sizes, of more ids than followers hold in 16 bits, empty files: together or one by one, the same."""
    rng = np.random.default_rng(5)
    many = [rng.zipf(1.3, 70_000) % 50_257, np.arange(20_000) * 99_991 % 2**32, np.zeros(0, np.int64), rng.integers(0, 9, 17)]
    raws = pack_files([([k], [len(ids)], ids) for k, ids in enumerate(many)])
    assert [r[2].tolist() for r in unpack_files(raws)] == [ids.tolist() for ids in many] == [unpack_file(r)[2].tolist() for r in raws]


def test_coding_takes_a_few_microseconds_an_id():
    """256 blocks there and back, in units of the CPU seconds that this machine takes for a plain loop (1 ms as a rule)."""
    ids = np.random.default_rng(6).zipf(1.2, 256 * 1024) % 50_257
    taken = []
    for _ in range(2):
        marks = [time.thread_time()]
        sum(range(50_000))
        marks.append(time.thread_time())
        assert np.array_equal(decode_blocks(encode_blocks(ids, 1024)), ids)
        marks.append(time.thread_time())
        taken.append((marks[2] - marks[1]) / (marks[1] - marks[0]))
    assert min(taken) < 6e-3 * len(ids)
