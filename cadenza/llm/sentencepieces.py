"""SentencePiece encoding and decoding: batched Viterbi in numpy, units of equal length advance together.

Texts are cut into units where no piece joins the two bytes, and each distinct unit is segmented once. Hashes of all substrings of all
units of one length probe the sorted hashes of the pieces, which gives a lattice of piece ids; then all units of a length go one
position further at a time, and vectorised maxima over the pieces that end there store backpointers.

Unigram models: the maximum is that of the summed scores. BPE models: the largest sum of scores is not what the library gives, since it
merges the best adjacent pair again and again. There a piece is *possible* after the piece before it if merging the text of the two
alone leaves these two, and what merging makes of a prefix ends with the longest possible piece (each text has one sequence of
pieces whose neighbours are all possible), so the maximum is over the lengths of possible pieces. Whether two neighbours are
possible is told by undoing their merges, the last first: no pair across the border may have been the better one to merge.
Units longer than :data:`LONG` are merged with a heap, in n log n steps. Tests hold both against the library.

Characters outside the pieces become byte pieces, or one unknown id for a run of them. The normaliser handled is the identity
with spaces as word marks (what the BPE model here has).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.shared import free_name, give_back, small_batches
from cadenza.llm.shingles import mix, slices, text_buffers
from cadenza.llm.units import take_units

MARK = "▁"
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_LOW_BITS = np.uint64((1 << 20) - 1)
#: Characters of a unit up to which units are segmented together.
LONG = 64


@dataclass
class Pieces:
    """A vocabulary: texts, scores, the ids that are ordinary pieces, and the algorithm it is for ("bpe" or "unigram")."""

    texts: list[str]
    scores: np.ndarray
    ordinary: np.ndarray
    kind: str
    unknown: int = 0
    prefix: bool = True

    def __post_init__(self) -> None:
        ids = np.flatnonzero(self.ordinary)
        lengths = np.array([len(self.texts[i]) for i in ids], np.int64)
        self.longest, keys = int(lengths.max(initial=1)), np.zeros(len(ids), np.uint64)
        for n in set(lengths.tolist()) - {0}:
            same = np.flatnonzero(lengths == n)
            keys[same] = _hash(_codes([self.texts[ids[i]] for i in same], n))[:, -1]
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order].astype(np.int32)
        self.filled = np.zeros(int(_LOW_BITS) + 1, bool)
        self.filled[keys & _LOW_BITS] = True
        # Ranks of scores, best first; no piece, at -1, has the last.
        self.rank = np.append(np.unique(-self.scores, return_inverse=True)[1], len(self.scores)).astype(np.int64)
        self.bytes_of = {i: int(t[3:5], 16) for i, t in enumerate(self.texts) if re.fullmatch(r"<0x[0-9A-F]{2}>", t)}
        self.byte_ids = np.full(256, self.unknown)
        for i, b in self.bytes_of.items():
            self.byte_ids[b] = i
        plain = [bytes([self.bytes_of[i]]) if i in self.bytes_of else t.replace(MARK, " ").encode() if self.ordinary[i] else b"" for i, t in enumerate(self.texts)]
        self.plain = pa.array(plain, pa.large_binary())
        # Bytes that follow each other in a piece; a text is cut between all others, but not within a character.
        self.joined = np.zeros((256, 256), bool)  # [first, second]
        for i in ids:
            raw = np.frombuffer(plain[i], np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.joined[:, 0x80:0xC0] = True
        self.known: dict[str, bytes] = {}
        if self.kind == "bpe":
            self.by_text = {self.texts[i]: int(self.rank[i]) for i in ids}
            self._undo(ids)

    def _undo(self, ids: np.ndarray) -> None:
        """Of each piece: its length, whether merging its text gives it, the rank of its last merge (-1: one character), its halves."""
        n = len(self.texts)
        self.size, self.reached, self.born = np.zeros(n + 1, np.int64), np.zeros(n + 1, bool), np.full(n + 1, -1, np.int64)
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        place = self.place = {self.texts[i]: int(i) for i in ids}
        for i in ids:
            text = self.texts[i]
            self.size[i] = len(text)
            ends, half = merged(self, text)
            if len(ends) == 2:
                self.reached[i] = True
                if len(text) > 1:
                    self.born[i], self.left[i], self.right[i] = self.rank[i], place.get(text[:half], -1), place.get(text[half:], -1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 for no piece; most hashes fail the table of low bits and are not searched for."""
        out = np.full(keys.shape, -1, np.int32)
        maybe = np.nonzero(self.filled[keys & _LOW_BITS])
        some = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == some, self.ids[at], -1)
        return out


def _codes(texts: list[str], n: int) -> np.ndarray:
    """Code points of texts of ``n`` characters."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(len(texts), n).astype(np.uint64)


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of rows of code points."""
    out, h = np.empty(codes.shape, np.uint64), np.zeros(len(codes), np.uint64)
    for i in range(codes.shape[1]):
        h = (h + codes[:, i] + np.uint64(1)) * _RADIX
        h ^= h >> np.uint64(29)
        out[:, i] = h
    return mix(out)


def load_pieces(path: str) -> Pieces:
    """The vocabulary of a .model file, its algorithm and whether a space goes before each text.

    A model that normalises texts further, or marks words in another way, raises: its ids would be wrong.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    norm, trained = proto.normalizer_spec, proto.trainer_spec
    kinds = {trained.UNIGRAM: "unigram", trained.BPE: "bpe"}
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix or trained.model_type not in kinds:
        raise ValueError(f"{path}: only BPE and unigram models with the identity normaliser and spaces as word marks are handled")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    if any(piece.type == piece.USER_DEFINED for piece in proto.pieces):
        raise ValueError(f"{path}: pieces that are always cut out are not handled")
    scores = np.array([p.get_score(i) for i in range(n)])
    ordinary = np.array([not (p.is_unknown(i) or p.is_control(i) or p.is_unused(i) or p.is_byte(i)) for i in range(n)])
    return Pieces([p.id_to_piece(i) for i in range(n)], scores, ordinary, kinds[trained.model_type], p.unk_id(), norm.add_dummy_prefix)


@cache
def kept_pieces(path: str) -> Pieces:
    """:func:`load_pieces`, once in a worker's life."""
    return load_pieces(path)


def merged(pieces: Pieces, unit: str) -> tuple[list[int], int]:
    """(borders of what merging makes of a unit, the border that the last merge took away)."""
    n, rank = len(unit), pieces.by_text
    after, before, alive = list(range(1, n + 2)), list(range(-1, n)), [True] * (n + 1)
    # Integers in the order of (rank, begin), with the lengths of both symbols.
    heap = [((r << 40 | s) << 32) | 0x10001 for s in range(n - 1) if (r := rank.get(unit[s : s + 2])) is not None]
    heapq.heapify(heap)
    half = 0
    while heap:
        best = heapq.heappop(heap)
        s = best >> 32 & 0xFFFFFFFFFF
        m = s + (best >> 16 & 0xFFFF)
        e = m + (best & 0xFFFF)
        if not (alive[s] and alive[m]) or after[s] != m or after[m] != e:
            continue  # one of the two has been merged since
        alive[m], after[s], half = False, e, m
        if e < n:
            before[e] = s
            if (r := rank.get(unit[s : after[e]])) is not None:
                heapq.heappush(heap, ((r << 40 | s) << 32) | (e - s) << 16 | (after[e] - e))
        if s > 0 and (r := rank.get(unit[(t := before[s]) : e])) is not None:
            heapq.heappush(heap, ((r << 40 | t) << 32) | (s - t) << 16 | (e - s))
    ends, at = [0], 0
    while at < n:
        at = after[at]
        ends.append(at)
    return ends, half


def _lattice(pieces: Pieces, codes: np.ndarray) -> np.ndarray:
    """[unit, start, length] -> piece id or -1; length 0 and the one past the longest are no piece."""
    rows, n = codes.shape
    most = min(n, pieces.longest)
    out = np.full((rows, n, most + 2), -1, np.int32)
    for start in range(n):
        wide = min(most, n - start)
        out[:, start, 1 : wide + 1] = pieces.find(_hash(codes[:, start : start + wide]))
    return out


def _possible(pieces: Pieces, lattice: np.ndarray, row: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether merging leaves the pieces x and y, which meet at ``at`` in their rows, apart.

    Their merges are undone, the last first (of equal ones the right, as merging goes from the left); a pair across the border that is
    better than what was undone last would have been merged before.
    """
    ok, live, over = np.ones(len(row), bool), np.arange(len(row)), lattice.shape[2] - 1
    limit = np.full(len(row), 2 * (len(pieces.scores) + 1))
    while live.size:
        a, b = pieces.size[x], pieces.size[y]
        joint = pieces.rank[lattice[row, at - a, np.minimum(a + b, over)]]
        apart = (2 * joint >= limit) | (joint == len(pieces.scores))
        ok[live[~apart]] = False
        bx, by = pieces.born[x], pieces.born[y]
        stay = apart & ((bx >= 0) | (by >= 0))
        live, row, at, x, y, bx, by = live[stay], row[stay], at[stay], x[stay], y[stay], bx[stay], by[stay]
        first = bx > by
        limit = np.where(first, 2 * bx, 2 * by + 1)
        x, y = np.where(first, pieces.right[x], x), np.where(first, y, pieces.left[y])
    return ok


def _viterbi(pieces: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, id or -1) of the last piece of each prefix of each row: [row, end]. Unknown characters are pieces of length 1."""
    lattice, (rows, n) = _lattice(pieces, codes), codes.shape
    back, last = np.zeros((rows, n + 1), np.int64), np.full((rows, n + 1), -1, np.int32)
    every, bpe = np.arange(rows), pieces.kind == "bpe"
    if not bpe:
        worst = float(pieces.scores[pieces.ordinary].min()) - 10
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
    for end in range(1, n + 1):
        lengths = np.arange(1, min(end, lattice.shape[2] - 2) + 1)
        ids = lattice[:, end - lengths, lengths]
        if bpe:
            maybe = pieces.reached[ids]
            row, which = np.nonzero(maybe & (last[:, end - lengths] >= 0))
            begin = end - lengths[which]
            maybe[row, which] = _possible(pieces, lattice, row, begin, last[row, begin], ids[row, which])
            value = np.where(maybe, lengths, 0)
        else:
            value = np.where(ids >= 0, pieces.scores[ids], np.where(lengths == 1, worst, -np.inf)) + best[:, end - lengths]
        at = value.argmax(1)
        back[:, end], last[:, end] = lengths[at], ids[every, at]
        if not bpe:
            best[:, end] = value[every, at]
    return back, last


def _ids(pieces: Pieces, unit: str, cut: list[tuple[int, int, int]]) -> np.ndarray:
    out: list[int] = []
    for s, e, i in cut:
        if i >= 0:
            out.append(i)
        elif pieces.bytes_of:
            out += pieces.byte_ids[np.frombuffer(unit[s:e].encode(), np.uint8)].tolist()
        else:
            out.append(pieces.unknown)
    return np.array(out, np.int32)


def segment(pieces: Pieces, units: Iterable[str]) -> dict[str, np.ndarray]:
    """ids of each of the (distinct) units, spaces as word marks."""
    by_length, out = {}, {}
    for unit in units:
        by_length.setdefault(len(unit), []).append(unit)
    for n, same in by_length.items():
        if n > LONG and pieces.kind == "bpe":
            for unit in same:
                marked = unit.replace(" ", MARK)
                ends, _ = merged(pieces, marked)
                out[unit] = _ids(pieces, marked, [(s, e, pieces.place.get(marked[s:e], -1)) for s, e in zip(ends, ends[1:], strict=False)])
            continue
        step = max(1, 1_000_000 // (n * min(n, pieces.longest)))
        for a in range(0, len(same), step):
            some = same[a : a + step]
            marked = [u.replace(" ", MARK) for u in some]
            back, last = _viterbi(pieces, _codes(marked, n))
            ends, at = np.zeros(back.shape, bool), np.full(len(some), n)
            rows = np.arange(len(some))
            while len(rows):
                ends[rows, at] = True
                at = at - back[rows, at]
                rows, at = rows[at > 0], at[at > 0]
            ids, bounds = last[ends], np.cumsum(ends.sum(1))[:-1]
            for unit, found in zip(some, np.split(ids, bounds), strict=True):
                out[unit] = found
            for row in np.flatnonzero((ends & (last < 0)).any(1)):
                borders = [0, *np.flatnonzero(ends[row]).tolist()]
                out[some[row]] = _ids(pieces, marked[row], [(s, e, int(last[row, e])) for s, e in zip(borders, borders[1:], strict=False)])
    return out


def encode_column(pieces: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's begin and the last end), as the library gives them without begin and end."""
    texts = pc.replace_substring(texts.fill_null("").cast(pa.large_string()), MARK, " ")
    if pieces.prefix:
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if x is not texts else x for x in (" ", texts, ""))))
    raw, offsets = text_buffers(texts)
    opens = np.ones(len(raw), bool)
    opens[1:] = ~pieces.joined.ravel().take((raw[:-1].astype(np.uint16) << 8) | raw[1:])
    ids, bounds = take_units(raw, offsets, opens, pieces.known, lambda units: segment(pieces, units))
    if not pieces.bytes_of:  # a run of unknown characters has one id
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == pieces.unknown) & (ids[:-1] == pieces.unknown)
        again[bounds[:-1][bounds[:-1] < len(ids)]] = False
        ids, bounds = ids[~again], bounds - np.concatenate([[0], np.cumsum(again)])[bounds]
    return ids, bounds


def encode_texts(pieces: Pieces, texts: list[str]) -> list[np.ndarray]:
    """ids of each text."""
    ids, bounds = encode_column(pieces, pa.array(texts, pa.large_string()))
    return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def decode_column(pieces: Pieces, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The texts of rows of ids; bytes that are no UTF-8 become U+FFFD."""
    taken = pieces.plain.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
    raw = np.frombuffer(taken.buffers()[2], np.uint8) if len(taken) and taken.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = ends[bounds]
    if pieces.prefix:  # the space before the first word
        some = at[:-1][at[:-1] < at[1:]]
        lead = some[raw[some] == 32] if len(some) else some
        raw = np.delete(raw[: at[-1]], lead)
        at = at - np.searchsorted(lead, at)
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(raw))])
    try:
        return out.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace") for x in out.to_pylist()], pa.string())


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of ids."""
    return decode_column(pieces, np.asarray(ids, np.int32), np.array([0, len(ids)]))[0].as_py()


def sentencepiece_ids(docs: DataFrame, *, model: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col``, array<int>, and if named the decoded text; columns of these names are replaced.

    Null texts count as empty and have no ids. Rows stay where they are: no shuffle, nothing per document on the driver.
    """
    small_batches(docs.sparkSession, 2)
    new = {ids_col.lower(), (decoded_col or ids_col).lower()}
    kept = [f for f in docs.schema if f.name.lower() not in new]
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])
    names = [f.name for f in kept]
    source = docs.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(free_name(docs.columns, "encoded_text")))

    def run(batches):
        pieces = kept_pieces(model)
        for batch in batches:
            _, offsets = text_buffers(batch.column(len(names)))
            for a, b in slices(offsets, 1 << 20):
                part = batch.slice(a, b - a)
                ids, bounds = encode_column(pieces, part.column(len(names)))
                columns = [part.column(i) for i in range(len(names))] + [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                if decoded_col:
                    columns.append(decode_column(pieces, ids, bounds))
                yield pa.RecordBatch.from_arrays(columns, [*names, *[f.name for f in added]])
        pieces.known.clear()  # the worker goes on to other tasks
        give_back()

    return source.mapInArrow(run, T.StructType([*kept, *added]))
