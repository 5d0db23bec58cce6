"""Fill-in-middle: texts are cut at unit boundaries into prefix, middle and suffix and written in another order between sentinels.

A table-driven automaton over bytes does the scan: its states say how far a sentinel has been read and whether the next byte opens a
unit, and each transition carries counts (a code point, an opened unit, a finished sentinel). Blocks of one size advance together, a
byte a step. The state at the start of a block is that of the automaton after the few bytes before it, since no state remembers more
than the longest sentinel. Sums of the counts by block give units and code points of every text; a second pass goes through the blocks
that hold a cut and finds its byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.shared import free_name, give_back, small_batches
from cadenza.llm.shingles import text_buffers

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a block; the counts of a block have 10 bits each.
BLOCK = 512
#: Blocks that advance together.
TOGETHER = 8192
_UNIT, _SENTINEL, _FIELD = 10, 20, 1023


def checked(sentinels: tuple[str, str, str]) -> list[bytes]:
    """The sentinels as bytes. None may hold another, and no end of one may begin another: else a text could make a false one."""
    raw = [s.encode() for s in sentinels]
    if len(raw) != 3 or not all(raw) or max(map(len, raw)) > BLOCK:
        raise ValueError(f"three sentinels of 1 to {BLOCK} bytes are needed")
    for i, a in enumerate(raw):
        for j, b in enumerate(raw):
            if (i != j and a in b) or any(a.endswith(b[:n]) for n in range(1, len(b))):
                raise ValueError(f"{sentinels[i]!r} and {sentinels[j]!r} overlap")
    return raw


@dataclass(frozen=True)
class Machine:
    """``follow[state + class]`` is the next state and ``counts`` the packed counts of a transition; states are multiples of the classes."""

    classes: np.ndarray  # of each byte; the last class is the padding after a text, which changes nothing
    follow: np.ndarray
    counts: np.ndarray
    first: int
    within: int
    reach: int  # bytes after which the state no longer depends on what came before

    @staticmethod
    def of(sentinels: list[bytes], unit_ends: bytes) -> Machine:
        """For units that end with one of the bytes ``unit_ends`` (ASCII) or, with none, are single code points."""
        heads = sorted({s[:n] for s in sentinels for n in range(len(s))}, key=lambda h: (len(h), h))
        places = {h: i for i, h in enumerate(heads)}
        bytes_ = range(256)
        follow, counts = np.zeros((2 * len(heads), 256), np.int64), np.zeros((2 * len(heads), 256), np.int32)
        for head, place in places.items():
            for b in bytes_:
                read = head + bytes([b])
                done = any(read.endswith(s) for s in sentinels)
                rest = next(read[n:] for n in range(len(read) + 1) if read[n:] in places)
                lead = not 0x80 <= b < 0xC0
                for opens in (0, 1):
                    unit = opens if unit_ends else lead
                    follow[2 * place + opens, b] = 2 * places[rest] + (b in unit_ends)
                    counts[2 * place + opens, b] = lead | unit << _UNIT | done << _SENTINEL
        _, first, classes = np.unique(np.vstack([follow, counts]), axis=1, return_index=True, return_inverse=True)
        states, n = np.arange(len(follow)), len(first) + 1
        follow = np.column_stack([follow[:, first], states]) * n
        counts = np.column_stack([counts[:, first], np.zeros(len(states), np.int32)])
        return Machine(classes.reshape(-1).astype(np.uint8), follow.ravel().astype(np.int32), counts.ravel().astype(np.int32), n, 0, max(map(len, sentinels)))

    def columns(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
        """Classes of ``width`` bytes from each start, a row a step; those beyond a block's size are padding. ``raw`` has a tail of ``width``."""
        some = self.classes[np.lib.stride_tricks.sliding_window_view(raw, width)[starts]]
        short = np.flatnonzero(sizes < width)
        some[short] = np.where(np.arange(width) < sizes[short, None], some[short], np.uint8(self.classes.max() + 1))
        return np.ascontiguousarray(some.T)

    def scan(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state at the start, packed counts) of each block; ``opening`` marks the first blocks of their texts."""
        begin, total = np.full(len(starts), self.first, np.int32), np.zeros(len(starts), np.int32)
        for a in range(0, len(starts), TOGETHER):
            part = slice(a, a + TOGETHER)
            later = np.flatnonzero(~opening[part]) + a
            state = np.full(len(later), self.within, np.int32)
            for step in self.columns(raw, starts[later] - self.reach, np.full(len(later), self.reach), self.reach):
                state = self.follow[state + step]
            begin[later] = state
            state, count = begin[part], total[part]
            for step in self.columns(raw, starts[part], sizes[part], BLOCK):
                at = state + step
                state = self.follow[at]
                count += self.counts[at]
        return begin, total

    def find(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code points before it) within its block of the ``wanted``-th unit that opens there."""
        place, before = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for a in range(0, len(starts), TOGETHER):
            part = slice(a, a + TOGETHER)
            state, count, want = begin[part], np.zeros(len(starts[part]), np.int32), wanted[part]
            missing = np.ones(len(want), bool)
            for j, step in enumerate(self.columns(raw, starts[part], sizes[part], BLOCK)):
                at = state + step
                state, after = self.follow[at], count + self.counts[at]
                hit = missing & ((after >> _UNIT & _FIELD) == want)
                place[part][hit], before[part][hit] = j, count[hit] & _FIELD
                missing &= ~hit
                count = after
        return place, before


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def cut_texts(machine: Machine, raw: np.ndarray, offsets: np.ndarray, draws: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Of each text: units, sentinels found, and for both cuts, in order, the byte and the code points before it.

    ``draws`` are two numbers a text; modulo units + 1 they are the units before the cuts.
    """
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    bounds = np.concatenate([[0], np.cumsum(blocks)])
    row = np.repeat(np.arange(len(lengths)), blocks)
    inner = (np.arange(bounds[-1]) - bounds[row]) * BLOCK
    starts, sizes = offsets[row] + inner, np.minimum(BLOCK, lengths[row] - inner)
    padded = np.concatenate([raw, np.zeros(BLOCK, np.uint8)])
    begin, total = machine.scan(padded, starts, sizes, inner == 0)
    chars, opened = (total & _FIELD).astype(np.int64), (total >> _UNIT & _FIELD).astype(np.int64)
    units = _sums(opened, bounds)
    all_chars = _sums(chars, bounds)
    reached, passed = np.cumsum(opened), np.concatenate([[0], np.cumsum(chars)])
    out = {"units": units, "sentinels": _sums(total >> _SENTINEL, bounds)}
    low, high = np.sort(np.stack([d % (units + 1) for d in draws]), axis=0)
    for name, cut in (("low", low), ("high", high)):
        byte, before = lengths.copy(), all_chars.copy()
        inside = np.flatnonzero(cut < units)
        # The unit that opens after the cut, counted over the whole batch.
        wanted = np.concatenate([[0], reached])[bounds[inside]] + cut[inside] + 1
        at = np.searchsorted(reached, wanted)
        place, more = machine.find(padded, starts[at], sizes[at], begin[at], wanted - reached[at] + opened[at])
        byte[inside] = inner[at] + place
        before[inside] = passed[at] - passed[bounds[inside]] + more
        out[f"{name}_byte"], out[f"{name}_chars"] = byte, before
    return out


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentinels: tuple[str, str, str] = SENTINELS,
    unit_ends: str = "\n",
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
) -> DataFrame:
    """``docs`` with ``text_col`` in fill-in-middle form, and n, form, prefix_chars and middle_chars (code points, null for plain) added.

    A text has n units: runs up to and with one of the characters ``unit_ends`` (ASCII), or single code points if there are none. The
    first four groups of 8 digits of the SHA-256 of ``seed:id`` draw two numbers of units before the cuts, whether a text is changed
    (``rate`` in 100) and its order (``spm_rate`` in 100: suffix, prefix, middle; else prefix, suffix, middle). Texts without
    units and those that hold a sentinel stay as they are, form plain; :func:`restored` gives every text back.

    Null texts count as empty. A null id is drawn for as an empty one; rows of one id and text come out alike. An empty table stays
    empty. Very long texts are scanned in blocks, ``TOGETHER`` at once; a task holds an Arrow batch and its output. Columns of
    the input with the names of the added ones are replaced, others stay. Rows stay where they are: nothing is shuffled.
    """
    small_batches(docs.sparkSession, 4)
    machine, raw_sentinels = Machine.of(checked(sentinels), unit_ends.encode("ascii")), checked(sentinels)
    added = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField(text_col, T.StringType())]
    kept = [f for f in docs.schema if f.name.lower() not in {a.name.lower() for a in added}]
    names = [f.name for f in kept]
    digest = free_name(docs.columns, "digest")
    hashed = docs.withColumn(digest, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256))
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(free_name(docs.columns, f"draw{i}")) for i in range(4)]
    source = hashed.select(*[F.col(f"`{n}`") for n in names], *draws, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(free_name(docs.columns, "whole_text")))

    def run(batches):
        p, s, m = raw_sentinels
        for batch in batches:
            raw, offsets = text_buffers(batch.column(len(names) + 4))
            h = [batch.column(len(names) + i).to_numpy() for i in range(4)]
            found = cut_texts(machine, raw, offsets, (h[0], h[1]))
            plain = (found["units"] == 0) | (found["sentinels"] > 0) | (h[2] % 100 >= rate)
            spm, texts = h[3] % 100 < spm_rate, []
            ends = zip(offsets[:-1], offsets[:-1] + found["low_byte"], offsets[:-1] + found["high_byte"], offsets[1:], plain, spm, strict=True)
            view = memoryview(np.ascontiguousarray(raw))
            for a, low, high, b, as_is, suffix_first in ends:
                if as_is:
                    texts.append(bytes(view[a:b]))
                elif suffix_first:
                    texts.append(b"".join((s, view[high:b], p, view[a:low], m, view[low:high])))
                else:
                    texts.append(b"".join((p, view[a:low], s, view[high:b], m, view[low:high])))
            columns = [
                pa.array(found["units"]),
                pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm"))).cast(pa.string()),
                pa.array(found["low_chars"], mask=plain),
                pa.array(found["high_chars"] - found["low_chars"], mask=plain),
                pa.array(texts, pa.binary()).view(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *columns], [*names, *[f.name for f in added]])
        give_back()

    return source.mapInArrow(run, T.StructType([*kept, *added]))


def restored(text: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text before :func:`fill_in_middle`."""
    parts = F.split(text, "|".join(f"\\Q{s}\\E" for s in sentinels))
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(text)
