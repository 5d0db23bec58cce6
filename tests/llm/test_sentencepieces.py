import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cadenza.llm.sentencepieces import Pieces, decode_ids, encode_texts, kept_pieces, load_pieces, sentencepiece_ids

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", " ", "   a  b ", "\n\t", "日本語のテキスト 漢字漢字", "😀😀 ok", "a" * 300, "=-" * 200, " " * 100 + "y" * 100, "<s> </s> <unk> <0x41>", "\x00\x01", "Ünïcödé naïve", "x" * 20_000]


def test_same_ids_as_the_library(docs):
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL), kept_pieces(MODEL)
    texts = ODD + [r.text or "" for r in docs.collect()]
    with np.errstate(over="ignore"):
        found = encode_texts(pieces, texts)
    assert [x.tolist() for x in found] == library.encode(texts)
    assert [decode_ids(pieces, x) for x in found] == texts


def test_frame_round_trip(spark, docs, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for table in (docs.withColumnRenamed("size", "ids"), odd_docs, no_docs):
        got = sentencepiece_ids(table, model=MODEL, decoded_col="decoded")
        assert set(got.columns) == {*table.columns, "ids", "decoded"}
        for r in got.collect():
            assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "")
        assert got.count() == table.count()


def test_long_unbroken_texts():
    """A megabyte without a place to cut is merged in n log n steps."""
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL), kept_pieces(MODEL)
    for text in ("ab" * 500_000, "x" * 1_000_000):
        began = time.process_time()
        with np.errstate(over="ignore"):
            found = encode_texts(pieces, [text])[0]
        assert time.process_time() - began < 15 and found.tolist() == library.encode(text)


@pytest.mark.parametrize("seed", range(3))
def test_viterbi_of_merges_on_random_texts(seed):
    """Joined pieces, repeated characters, digits, marks and rare letters: the library's ids, through the batched Viterbi."""
    rng, pieces = np.random.default_rng(seed), kept_pieces(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    some = [pieces.texts[i].replace("▁", " ") for i in pieces.ids]
    texts = ["".join(some[i] for i in rng.integers(0, len(some), rng.integers(1, 7))) for _ in range(2000)]
    texts += ["".join(rng.choice(list("ab=-_. \n\t0a"), rng.integers(1, 60))) for _ in range(1000)]
    texts += ["".join(map(chr, rng.choice([97, 98, 233, 337, 1080, 20013, 128512], rng.integers(1, 30)))) for _ in range(500)]
    with np.errstate(over="ignore"):
        assert [x.tolist() for x in encode_texts(pieces, texts)] == library.encode(texts)


def test_runs_of_unknown_characters():
    """Without byte pieces, a run of unknown characters has one id, across units as well."""
    texts = ["<unk>", "▁", "a", "▁a", "aa"]
    pieces = Pieces(texts, np.array([0.0, -1, -2, -3, -4]), np.array([t != "<unk>" for t in texts]), "bpe")
    with np.errstate(over="ignore"):
        assert [x.tolist() for x in encode_texts(pieces, ["aé漢字a", "é", "", "éa"])] == [[3, 0, 2], [1, 0], [], [1, 0, 2]]


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_against_brute_force(seed):
    """Unigram models: the best sum of scores over all segmentations."""
    rng = np.random.default_rng(seed)
    texts = ["<unk>", *sorted({"▁", *("".join(rng.choice(list("ab▁"), rng.integers(1, 4))) for _ in range(12)), "a", "b"})]
    scores = np.array([0.0, *(-rng.random(len(texts) - 1) * 5)])
    pieces = Pieces(texts, scores, np.array([t != "<unk>" for t in texts]), "unigram")
    value = dict(zip(texts[1:], scores[1:], strict=True))

    def best(unit):
        top = [0.0]
        for end in range(1, len(unit) + 1):
            top.append(max(top[s] + value[unit[s:end]] for s in range(end) if unit[s:end] in value))
        return top[-1]

    for _ in range(30):
        unit = "▁" + "".join(rng.choice(list("ab"), rng.integers(0, 9)))
        with np.errstate(over="ignore"):
            ids = encode_texts(pieces, [unit.replace("▁", "")])[0].tolist() if unit != "▁" else []
        if ids:
            assert "".join(texts[i] for i in ids) == unit and abs(sum(scores[i] for i in ids) - best(unit)) < 1e-9


@pytest.mark.parametrize("change", [lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"), lambda m: setattr(m.trainer_spec, "model_type", 4), lambda m: setattr(m.pieces[900], "type", 4)])
def test_models_that_are_not_handled(tmp_path, change):
    from sentencepiece import sentencepiece_model_pb2

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    change(model)
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        load_pieces(str(path))


def test_a_model_without_a_space_before_the_text(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.normalizer_spec.add_dummy_prefix = False
    path = tmp_path / "bare.model"
    path.write_bytes(model.SerializeToString())
    library, texts = sentencepiece.SentencePieceProcessor(model_file=str(path)), ["house", " house", "the old  man", ""]
    assert [x.tolist() for x in encode_texts(load_pieces(str(path)), texts)] == library.encode(texts)
