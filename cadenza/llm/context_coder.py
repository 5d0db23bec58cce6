"""An adaptive context-mixing range coder for token ids, in independently reset blocks that are coded side by side.

A block numbers its ids as they first appear. Each number is predicted from what its block has coded so far:

* order 2 names what followed the last two ids, order 1 what followed the last id, each with a trust that grows with every hit. What
  comes next is one of four: order 2 is right, order 1 is right, another known id, a new id. The probability of each is mixed from
  adaptive ones under several contexts (trusts, whether both agree, the last outcome): logistic mixing with weights that learn;
* order 0 has adaptive counts of all ids and codes those that neither named.

What the orders name changes with every id. Counts, probabilities and weights are renewed at places that depend on nothing but the
number of ids before (:func:`_renewals`). The ids behind the numbers are coded apart: the counts of their bits adaptively. All
arithmetic is on whole numbers, so any machine decodes alike. Blocks are rows of numpy arrays: one step codes the next id of every
block. A block depends on no other; each carries the CRC-32 of its ids as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, at most.
BLOCK = 1 << 15
#: Order-2 contexts of a block.
SLOTS = 1 << 14
#: Numbers of ids up to which followers take 16 bits.
NARROW = 1 << 14
#: Contexts of an outcome: trusts of both orders (2 bits each), whether they agree, whether one was right before.
CONTEXTS = 64
_CONTEXT = np.arange(CONTEXTS)
_TRUST2, _TRUST1, _AGREE = _CONTEXT >> 4, _CONTEXT >> 2 & 3, (_CONTEXT >> 1 & 1).astype(bool)
#: Contexts of the adaptive probabilities that are mixed, and the parts of a context that they leave out.
_VIEWS = [_TRUST2 * 2 + _AGREE, _TRUST1 * 2 + _AGREE, _CONTEXT & 3, _CONTEXT]
_WITHOUT = [(-3, -1), (-4, -1), (-4, -3), ()]
_ASKED2 = _TRUST2 > 0
_ASKED1 = (_TRUST1 > 0) & ~(_AGREE & _ASKED2)
#: Logarithms of odds, times 256, of probabilities in 4096ths, and back.
_STRETCH = np.clip(np.round(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))), -2047, 2047).astype(np.int32)
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 1, 4095).astype(np.int32)
#: A span is between 2**30 and 2**62; words have 32 bits.
_FULL, _LOW = 62, 1 << 30


def _renewals(steps: int, least: int = 64, most: int = 512) -> list[tuple[int, int]]:
    """Stretches of steps; the model is renewed between them."""
    found, at = [], 0
    while at < steps:
        end = min(steps, at + min(max(least, at >> 3), most))
        found.append((at, end))
        at = end
    return found


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b of numbers that are not negative, without the care for signs."""
    return (a.view(np.uint64) // b.view(np.uint64)).view(np.int64)


class _Model:
    """What is renewed between stretches: probabilities of outcomes and counts of ids."""

    def __init__(self, rows: int) -> None:
        self.rows = rows
        # of three questions (order 2? else order 1? else known?): [view][so or asked, question, row, context]
        self.seen = [np.zeros((2, 3, rows, v.max() + 1), np.int32) for v in _VIEWS]
        self.weights = np.full((3, len(_VIEWS), rows, 1), 65536 // 4, np.int32)
        self.counts = np.zeros((rows, 0), np.int32)
        self._mix()

    def _mix(self) -> None:
        prior = np.array([6, 6, 1], np.int32)[:, None, None]
        self.inputs = [_STRETCH.take((((yes * 2 + 1) << 11) // (asked + prior)).take(v, axis=2)) for (yes, asked), v in zip(self.seen, _VIEWS, strict=True)]
        mixed = sum(x * w for x, w in zip(self.inputs, self.weights.swapaxes(0, 1), strict=True)) >> 16
        self.p = _SQUASH.take(np.clip(mixed, -2047, 2047) + 2047)
        first = np.where(_ASKED2, np.clip(self.p[0] >> 2, 1, 1020), 0)
        second = first + np.where(_ASKED1, np.clip((1024 - first) * self.p[1] >> 12, 1, 1021 - first), 0)
        third = second + np.clip((1024 - second) * self.p[2] >> 12, 1, 1023 - second)
        self.edges = (first | second << 10 | third << 20).astype(np.int64).ravel()

    def renew(self, known: np.ndarray, ahead: int) -> None:
        """Counts of the ids so far; ``known``: how many different ones each row has; ``ahead``: steps of the next stretch.

        An id that first appears in that stretch has a count of one at once, behind all others.
        """
        width = int(known.max()) + ahead
        counts = np.zeros((self.rows, width), np.int32)
        counts[:, : min(width, self.counts.shape[1])] = self.counts[:, :width]
        self.counts, self.width, self.total = counts, width, counts.sum(1, dtype=np.int64)
        beyond = np.arange(width, dtype=np.int32) - known[:, None].astype(np.int32)
        self.own = np.where((beyond >= 0) & (beyond < ahead), 1, counts)
        places = np.cumsum(self.own, axis=1, dtype=np.int32)
        places -= self.own
        places <<= 16
        places |= self.own
        self.places = places.view(np.uint32).ravel()

    def slots(self, ahead: int) -> tuple[np.ndarray, np.ndarray]:
        """(the id of each place of order 0, row by row, where the rows begin)."""
        ids = np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), self.rows), self.own.ravel())
        ends = np.cumsum(self.total + ahead)
        return ids, ends - self.total - ahead

    def learn(self, ids: np.ndarray, outcomes: np.ndarray) -> None:
        """From a stretch, [step, row]: numbers of ids, and 4 * context + which of four."""
        row = np.arange(self.rows)
        own = (row * self.width + ids)[(outcomes & 3) > 1]
        self.counts += np.bincount(own, minlength=self.rows * self.width).reshape(self.rows, -1)
        met = np.bincount((row * (4 * CONTEXTS) + outcomes).ravel(), minlength=self.rows * 4 * CONTEXTS).reshape(self.rows, CONTEXTS, 4)
        met = np.ascontiguousarray(np.moveaxis(met, 2, 0), np.int32)
        rest = met[2] + met[3]
        yes = met[:3]
        asked = np.stack([met.sum(0) * _ASKED2, (met[1] + rest) * _ASKED1, rest])
        # whole numbers below 2**53: exact in any order of adding
        wrong = ((yes << 12) - asked * self.p).astype(np.float64)
        total = asked.sum(2).astype(np.int64)
        both = np.stack([yes, asked]).reshape(2, 3, self.rows, 4, 4, 2, 2)
        for i, (x, out) in enumerate(zip(self.inputs, _WITHOUT, strict=True)):
            slope = np.einsum("qrc,qrc->qr", wrong, x.astype(np.float64)).astype(np.int64)
            moved = self.weights[:, i, :, 0] + ((slope // np.maximum(total, 1) * np.minimum(total, 64)) >> 12)
            self.weights[:, i, :, 0] = np.clip(moved, -(1 << 17), 1 << 17)
            self.seen[i] += both.sum(out, dtype=np.int32).reshape(self.seen[i].shape)
        self._mix()


class _Followers:
    """For each context of a block the id that followed it, and how surely (0: none yet, to 3); order 1 and order 2 side by side."""

    def __init__(self, rows: int, steps: int, kind: type) -> None:
        # rows don't begin at multiples of a power of two, which would crowd a few lines of the cache
        self.wide1, self.wide2, self.kind = min(steps, NARROW if kind is np.uint16 else steps) + 33, SLOTS + 96, kind
        self.table = np.zeros(rows * (self.wide1 + self.wide2), kind)
        self.base1, self.base2 = np.arange(rows) * self.wide1, rows * self.wide1 + np.arange(rows) * self.wide2

    def places(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """[order, ...] of ids that are [..., row]."""
        at = np.empty((2, *last.shape), np.int64)
        np.add(self.base1, last, out=at[0])
        spot = before * 40503
        spot += last * 30011
        spot >>= 3
        spot ^= last
        spot &= SLOTS - 1
        np.add(self.base2, spot, out=at[1])
        return at

    def learn(self, at: np.ndarray, found: np.ndarray, named: np.ndarray, trust: np.ndarray, ids: np.ndarray) -> None:
        self.table[at] = np.where(named == ids, found + (trust < 3), np.where(trust > 1, found - self.kind(1), ids << self.kind(2) | self.kind(1)))


class _Encoder:
    """Range coding of one symbol a row. One shift is always enough for what is narrowed between two."""

    def __init__(self, rows: int, words: int) -> None:
        self.low, self.span, self.wide = np.zeros(rows, np.int64), np.full(rows, 1 << _FULL, np.int64), words + 9
        self.out, self.at = np.zeros(rows * self.wide, np.uint32), np.arange(rows) * self.wide

    def settle(self, at: np.ndarray) -> None:
        """Gives out a word of the rows ``at``."""
        low, place = self.low[at], self.at[at]
        self.out[place] = low >> (_FULL - 32) & 0xFFFFFFFF
        if (over := low >> _FULL).any():
            up = place[over > 0] - 1
            while up.size:
                self.out[up] += np.uint32(1)
                up = up[self.out[up] == 0] - 1
        self.at[at] = place + 1
        self.low[at] = (low & ((1 << (_FULL - 32)) - 1)) << 32
        self.span[at] <<= 32

    def some(self, at: np.ndarray, total: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> None:
        unit = _quotient(self.span[at], total)
        self.low[at] += unit * start
        self.span[at] = span = unit * size
        self.settle(at[span < _LOW])

    def codes(self) -> list[bytes]:
        for _ in range(2):
            self.settle(np.arange(len(self.low)))
        return [self.out[i * self.wide : end].astype("<u4").tobytes() for i, end in enumerate(self.at.tolist())]


class _Decoder:
    def __init__(self, codes: list[bytes]) -> None:
        self.wide = max(map(len, codes)) // 4 + 4
        words = np.zeros((len(codes), self.wide), np.uint32)
        for row, code in enumerate(codes):
            words[row, : len(code) // 4] = np.frombuffer(code, "<u4", len(code) // 4)
        self.seen, self.span = words[:, 0].astype(np.int64) << (_FULL - 32) | words[:, 1] >> np.uint32(2), np.full(len(codes), 1 << _FULL, np.int64)
        # what a shift takes in lies across two words
        words[:, :-1] = words[:, :-1] << np.uint32(30) | words[:, 1:] >> np.uint32(2)
        self.words, self.at = words.ravel(), np.arange(len(codes)) * self.wide + 1
        self.last = np.arange(1, len(codes) + 1) * self.wide - 1

    def settle(self, at: np.ndarray) -> None:
        """Takes in a word of the rows ``at``. Blocks that have ended read zeros; what they give is not kept."""
        place = self.at[at]
        self.seen[at] = self.seen[at] << 32 | self.words.take(place)
        self.at[at] = np.minimum(place + 1, self.last[at])
        self.span[at] <<= 32

    def some(self, at: np.ndarray, total: np.ndarray, edge: np.ndarray | None = None) -> np.ndarray:
        """The place that a symbol begins at, or with ``edge`` the symbol."""
        seen = self.seen[at]
        unit = _quotient(self.span[at], total)
        found = start = np.minimum(_quotient(seen, unit), total - 1)
        size: np.ndarray | int = 1
        if edge is not None:
            row, found = np.arange(len(at)), (edge[:, 1:] <= found[:, None]).sum(1)
            start = edge[row, found]
            size = edge[row, found + 1] - start
        self.seen[at] = seen - unit * start
        self.span[at] = span = unit * size
        self.settle(at[span < _LOW])
        return found


class _Names:
    """The ids behind the numbers: the count of bits with the second bit, adaptively, and the bits behind as they are."""

    def __init__(self, rows: int) -> None:
        self.counts = np.ones((rows, 67), np.int64)

    def renew(self) -> None:
        self.edges = np.concatenate([np.zeros((len(self.counts), 1), np.int64), np.cumsum(self.counts, axis=1)], axis=1)

    @staticmethod
    def parts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, number of bits behind)."""
        bits = np.frexp(ids.astype(np.float64))[1].astype(np.int64)
        tail = np.maximum(bits - 2, 0)
        return np.where(bits > 1, 2 * bits + (ids >> tail & 1), bits), tail


def _in_turn(known: np.ndarray) -> list[tuple[int, int]]:
    return _renewals(int(known.max()), 32, 256)


def _encode_names(names: np.ndarray, known: np.ndarray) -> list[bytes]:
    """Codes of the first ``known`` of each row."""
    rows = np.arange(len(known))
    coder, coded = _Encoder(len(known), 2 * int(known.max())), _Names(len(known))
    for a, b in _in_turn(known):
        coded.renew()
        symbols, tails = coded.parts(names[:, a:b])
        for i in range(a, b):
            some = np.flatnonzero(known > i)
            symbol, tail = symbols[some, i - a], tails[some, i - a]
            coder.some(some, coded.edges[some, -1], coded.edges[some, symbol], coded.counts[some, symbol])
            coder.some(some, 1 << tail, names[some, i] & ((1 << tail) - 1), 1)
        np.add.at(coded.counts, (rows[:, None], symbols), np.arange(a, b) < known[:, None])
    return coder.codes()


def _decode_names(codes: list[bytes], known: np.ndarray) -> np.ndarray:
    rows = np.arange(len(known))
    names, coder, coded = np.zeros((len(known), max(1, int(known.max()))), np.int64), _Decoder(codes), _Names(len(known))
    for a, b in _in_turn(known):
        coded.renew()
        symbols = np.zeros((len(known), b - a), np.int64)
        for i in range(a, b):
            some = np.flatnonzero(known > i)
            edge = coded.edges[some]
            symbols[some, i - a] = symbol = np.minimum(coder.some(some, edge[:, -1], edge), 65)
            bits = np.where(symbol > 3, symbol >> 1, np.minimum(symbol, 1))
            tail = np.maximum(bits - 2, 0)
            names[some, i] = coder.some(some, 1 << tail) | np.where(bits > 1, (2 + (symbol & 1)) << tail, bits)
        np.add.at(coded.counts, (rows[:, None], symbols), np.arange(a, b) < known[:, None])
    return names


def _numbered(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place of each id's first appearance among its row's different ids, whether it is that appearance) of [row, step]."""
    rows, steps = grid.shape
    key = np.sort(grid.astype(np.int64) << 16 | np.arange(steps), axis=1)
    place = (key & 0xFFFF) + np.arange(rows)[:, None] * steps
    key >>= 16
    opens = np.ones((rows, steps), bool)
    opens[:, 1:] = key[:, 1:] != key[:, :-1]
    first = np.zeros(rows * steps, bool)
    first[place[opens]] = True
    number = (np.cumsum(first.reshape(rows, steps), axis=1, dtype=np.int32) - 1).ravel()
    local = np.empty(rows * steps, np.uint16)
    local[place.ravel()] = np.repeat(number[place[opens]].astype(np.uint16), np.diff(np.flatnonzero(np.append(opens.ravel(), True))))
    return local.reshape(rows, steps), first.reshape(rows, steps)


def _encode(grid: np.ndarray) -> list[bytes]:
    """Codes of rows of ids."""
    rows, steps = grid.shape
    history, first = np.zeros((steps + 2, rows), np.uint16), np.empty((steps, rows), bool)
    for a in range(0, rows, 32):  # in turn, for memory
        local, opens = _numbered(grid[a : a + 32])
        history[2:, a : a + 32], first[:, a : a + 32] = local.T, opens.T
    known, row = first.sum(0), np.arange(rows)
    names = np.zeros((rows, int(known.max())), np.int64)
    names[np.repeat(row, known), np.concatenate([np.arange(n) for n in known])] = grid[first.T]
    named_codes = _encode_names(names, known)
    kind = np.uint16 if known.max() <= NARROW else np.uint32
    model, followers, coder = _Model(rows), _Followers(rows, steps, kind), _Encoder(rows, steps)
    right, known = np.zeros(rows, bool), np.zeros(rows, np.int64)
    for a, b in _renewals(steps):
        model.renew(known, b - a)
        numbers, new = history[a : b + 2].astype(np.int64), first[a:b]
        at = followers.places(numbers[:-2], numbers[1:-1]).swapaxes(0, 1).copy()
        found, ids, numbers = np.empty(at.shape, kind), history[a + 2 : b + 2].astype(kind), numbers[2:]
        for spot, e, x in zip(at, found, ids, strict=True):
            followers.table.take(spot, out=e, mode="clip")
            followers.learn(spot, e, e >> kind(2), e & kind(3), x)
        trust1, trust2, named1, named2 = found[:, 0] & kind(3), found[:, 1] & kind(3), found[:, 0] >> kind(2), found[:, 1] >> kind(2)
        is2 = (trust2 > 0) & (named2 == ids)
        is1 = (trust1 > 0) & (named1 == ids) & ~is2
        which = 2 + new - is1 - 2 * is2
        hit = is1 | is2
        context = (trust2 << kind(4) | trust1 << kind(2) | (named1 == named2) << kind(1)).astype(np.int64)
        context[0] += right
        context[1:] += hit[:-1]
        right = hit[-1]
        edges = model.edges.take(row * CONTEXTS + context)
        start = np.where(which > 0, edges >> 10 * (which - 1) & 1023, 0)
        size = np.where(which < 3, edges >> 10 * which & 1023, 1024) - start
        # rows that order 0 doesn't code take all of a total of one
        other = which == 2
        place = np.where(other, model.places.take(row * model.width + numbers), np.uint32(1)).astype(np.int64)
        total = np.where(other, model.total + np.cumsum(new, axis=0), 1)
        start0, size0 = place >> 16, place & 0xFFFF
        for s, n, t, s0, n0 in zip(start, size, total, start0, size0, strict=True):
            unit = coder.span >> 10
            span = unit * n
            unit *= s
            coder.low += unit
            unit = _quotient(span, t)
            coder.span = unit * n0
            unit *= s0
            coder.low += unit
            coder.settle((coder.span < _LOW).nonzero()[0])
        model.learn(numbers, context * 4 + which)
        known = known + new.sum(0)
    head = [struct.pack("<BI", kind is np.uint32, len(x)) for x in named_codes]
    return [h + x + y for h, x, y in zip(head, named_codes, coder.codes(), strict=True)]


def _decode(codes: list[bytes], named_codes: list[bytes], steps: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each row's numbers, numbers [step, row]) of codes; a row that has ended goes on with what is not kept."""
    rows = len(codes)
    model, followers, coder = _Model(rows), _Followers(rows, steps, kind), _Decoder(codes)
    history = np.zeros((steps, rows), np.uint16)
    row, known, right = np.arange(rows), np.zeros(rows, np.int64), np.zeros(rows, bool)
    before, last = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    base, limits, found = row * CONTEXTS, np.zeros((5, rows), np.int64), np.empty((2, rows), kind)
    shifts, most = np.array([[0], [10], [20]]), followers.wide1 - 1
    for a, b in _renewals(steps):
        model.renew(known, b - a)
        (slots, row_slots), row_places, total = model.slots(b - a), row * model.width, model.total.copy()
        outcomes = np.empty((b - a, rows), np.int64)
        for i in range(a, b):
            at = followers.places(before, last)
            followers.table.take(at, out=found, mode="clip")
            named, trust = found >> kind(2), found & kind(3)
            context = (trust[1] << kind(4) | trust[0] << kind(2)).astype(np.int64)
            context += (named[0] == named[1]) * 2
            context += right
            unit = coder.span >> 10
            np.multiply(model.edges.take(base + context) >> shifts & 1023, unit, out=limits[1:4])
            np.left_shift(unit, 10, out=limits[4])
            over = coder.seen >= limits[1:4]
            which = over.sum(0)
            np.add(context * 4, which, out=outcomes[i - a])
            which *= rows
            which += row
            low = limits.take(which)
            seen = coder.seen - low
            span = limits.take(which + rows) - low
            right = ~over[1]
            new = over[2]
            total += new
            # as in the encoder, rows that order 0 doesn't code take all of a total of one
            other = over[1] & ~new
            own = np.where(other, np.maximum(total, 1), 1)
            unit = _quotient(span, own)
            spot = np.minimum(_quotient(seen, unit), own - 1)
            number = slots.take(row_slots + spot).astype(np.int64)
            place = np.where(other, model.places.take(row_places + number), np.uint32(1)).astype(np.int64)
            coder.seen = seen - unit * (place >> 16)
            coder.span = unit * (place & 0xFFFF)
            coder.settle((coder.span < _LOW).nonzero()[0])
            number = np.where(other, number, np.where(over[0], named[0], named[1]))
            if new.any():
                number = np.where(new, np.minimum(known + (total - model.total) - 1, most), number)
            followers.learn(at, found, named, trust, number.astype(kind))
            history[i] = number
            before, last = last, number
        model.learn(history[a:b].astype(np.int64), outcomes)
        known = known + (total - model.total)
    return _decode_names(named_codes, known), history


def encode_all(parts: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """(number of ids, CRC-32, code) of blocks of any sizes from 1 to ``BLOCK``, coded side by side; ids are below 2**32."""
    grid = np.zeros((len(parts), max(map(len, parts))), np.uint32)  # shorter blocks end with zeros that are not kept
    for row, part in zip(grid, parts, strict=True):
        row[: len(part)] = part
    return [(len(part), zlib.crc32(row[: len(part)].astype("<u4").tobytes()), code) for part, row, code in zip(parts, grid, _encode(grid), strict=True)]


def cut(ids: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """Parts of equal size, ``block`` ids at most."""
    rows = -(-len(ids) // block)
    bounds = np.arange(rows + 1) * len(ids) // max(rows, 1)
    return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[tuple[int, int, bytes]]:
    """(number of ids, CRC-32, code) of blocks of equal size, ``block`` ids at most; ids are below 2**32."""
    return encode_all(cut(ids, block)) if len(ids) else []


class BlockError(ValueError):
    """A block whose checksum differs."""


def decode_all(blocks: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """The ids of each block; each is verified. Blocks are decoded side by side, wherever they come from."""
    parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for first in {code[:1] for _, _, code in blocks}:
        same = [i for i, (_, _, code) in enumerate(blocks) if code[:1] == first]
        steps = max(blocks[i][0] for i in same)
        sizes = [struct.unpack_from("<BI", blocks[i][2])[1] + 5 for i in same if len(blocks[i][2]) > 4]
        if first not in (b"\0", b"\1") or steps > BLOCK or len(sizes) < len(same) or any(n > len(blocks[i][2]) for n, i in zip(sizes, same, strict=True)):
            raise BlockError("a block without a valid header")
        names, history = _decode([blocks[i][2][n:] for n, i in zip(sizes, same, strict=True)], [blocks[i][2][5:n] for n, i in zip(sizes, same, strict=True)], steps, np.uint32 if first == b"\1" else np.uint16)
        for row, i in enumerate(same):
            n, crc, _ = blocks[i]
            parts[i] = names[row].take(history[:n, row], mode="clip").astype(np.uint32)
            if zlib.crc32(parts[i].astype("<u4").tobytes()) != crc:
                raise BlockError(f"block {i} fails its checksum")
    return parts


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of blocks that follow each other."""
    return np.concatenate([np.zeros(0, np.int64), *decode_all(blocks)])
