"""Files of models: nuisance bases, whole mixtures with full covariances, and chains with any kind of states. Little-endian.

A model has the size of a model: it is written and read by the driver, at a URI that pyarrow opens.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
from pyarrow import fs

from cadenza.operators.accumulators import FullGaussians
from cadenza.operators.chains import FrameChain
from cadenza.operators.models import Chain, Mixture
from cadenza.sources.formats import FormatError, mixture_bytes, mixture_of


def save(path: str, raw: bytes) -> None:
    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as f:
        f.write(raw)


def load(path: str) -> bytes:
    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    with store.open_input_stream(name) as f:
        return f.read()


class _Cursor:
    """Fields of a file, one after the other; a file that ends early, or goes on, raises."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def fields(self, form: str) -> tuple:
        if self.at + struct.calcsize(form) > len(self.raw):
            raise FormatError("a model file that ends early")
        out = struct.unpack_from(form, self.raw, self.at)
        self.at += struct.calcsize(form)
        return out

    def numbers(self, n: int, kind: str) -> np.ndarray:
        if n < 0 or self.at + n * np.dtype(kind).itemsize > len(self.raw):
            raise FormatError("a model file that ends early")
        out = np.frombuffer(self.raw, kind, n, self.at).astype(np.float64)
        self.at += n * np.dtype(kind).itemsize
        return out

    def end(self) -> None:
        if self.at != len(self.raw):
            raise FormatError("a model file of another size than its header says")


def nuisance_bytes(basis: np.ndarray) -> bytes:
    """Directions and width, then the directions in single precision."""
    return struct.pack("<ii", *basis.shape) + basis.astype("<f4").tobytes()


def _nuisance(c: _Cursor) -> np.ndarray:
    n, d = c.fields("<ii")
    return c.numbers(n * d, "<f4").reshape(n, d)


def nuisance_of(raw: bytes) -> np.ndarray:
    c = _Cursor(raw)
    out = _nuisance(c)
    c.end()
    return out


def block_nuisance_bytes(bases: list[np.ndarray]) -> bytes:
    """Width of a block and number of blocks, then the basis of each."""
    if len({b.shape[1] for b in bases}) != 1:
        raise ValueError("blocks of one width are needed")
    return struct.pack("<ii", bases[0].shape[1], len(bases)) + b"".join(nuisance_bytes(b) for b in bases)


def block_nuisance_of(raw: bytes) -> list[np.ndarray]:
    c = _Cursor(raw)
    width, n = c.fields("<ii")
    out = [_nuisance(c) for _ in range(n)]
    c.end()
    if any(b.shape[1] != width for b in out):
        raise FormatError("a block of another width")
    return out


def full_mixture_bytes(weights: np.ndarray, means: np.ndarray, packed: np.ndarray, model_id: int = 0) -> bytes:
    """A mixture file of full covariances, each packed as the rows of its lower triangle."""
    d = means.shape[1]
    if packed.shape != (len(means), d * (d + 1) // 2):
        raise ValueError("a covariance has d (d + 1) / 2 numbers")
    out = struct.pack("<iiii", model_id, d, len(means), 1)
    return out + b"".join(struct.pack("<id", i, w) + m.astype("<f8").tobytes() + p.astype("<f8").tobytes() for i, (w, m, p) in enumerate(zip(weights, means, packed, strict=True)))


def full_mixture_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, packed covariances); a diagonal file gives covariances without products."""
    c = _Cursor(raw)
    _, d, n, full = c.fields("<iiii")
    size = d * (d + 1) // 2
    weights, means, packed = np.zeros(n), np.zeros((n, d)), np.zeros((n, size))
    ends = np.cumsum(np.arange(1, d + 1)) - 1
    for i in range(n):
        _, weights[i] = c.fields("<id")
        means[i] = c.numbers(d, "<f8")
        if full:
            packed[i] = c.numbers(size, "<f8")
        else:
            packed[i, ends] = c.numbers(d, "<f8")
    c.end()
    return weights, means, packed


def packed_covariances(model: FullGaussians) -> np.ndarray:
    """The covariances whose factors a model holds, packed."""
    d = model.means.shape[1]
    low, out = np.tril_indices(d), np.empty_like(model.factors)
    for i, factor in enumerate(model.factors):
        whole = np.zeros((d, d))
        whole[low] = factor
        out[i] = (whole @ whole.T)[low]
    return out


def states_bytes(chain: Chain | FrameChain, codebook_id: int | None = None, model_id: int = 0) -> bytes:
    """A chain file: id, states, initial and transition probabilities in single precision, then each state with its kind.

    d: alphabet and probabilities of symbols. c: a mixture of its own. s, where ``codebook_id`` is given: weights and the codebook's id;
    the codebook is a mixture file of its own.
    """
    out = struct.pack("<ih", model_id, len(chain.initial)) + chain.initial.astype("<f4").tobytes() + chain.transitions.astype("<f4").tobytes()
    for s in range(len(chain.initial)):
        if isinstance(chain, Chain):
            e = chain.emissions[s]
            out += b"d" + struct.pack("<i", len(e)) + np.arange(len(e), dtype="<f8").tobytes() + struct.pack("<i", len(e)) + e.astype("<f8").tobytes()
        elif codebook_id is None:
            m = chain.mixture(s)
            out += b"c" + mixture_bytes(m.weights, m.means, m.variances, s)
        else:
            w = chain.weights[s]
            out += b"s" + struct.pack("<i", len(w)) + w.astype("<f8").tobytes() + struct.pack("<i", codebook_id)
    return out


@dataclass(frozen=True)
class Codebooks:
    """Mixtures by the id that chain files name."""

    by_id: dict[int, Mixture]

    def __getitem__(self, key: int) -> Mixture:
        if key not in self.by_id:
            raise FormatError(f"missing codebook {key}")
        return self.by_id[key]


def states_of(raw: bytes, codebooks: Codebooks | None = None) -> Chain | FrameChain:
    """The chain of a file whose states are of one kind, and those with a shared codebook of one codebook."""
    c = _Cursor(raw)
    _, n = c.fields("<ih")
    initial, moves = c.numbers(n, "<f4"), c.numbers(n * n, "<f4").reshape(n, n)
    kinds, own, books = set(), [], set()
    for _ in range(n):
        (kind,) = c.fields("<c")
        kinds.add(kind)
        if kind == b"d":
            c.numbers(c.fields("<i")[0], "<f8")
            own.append(c.numbers(c.fields("<i")[0], "<f8"))
        elif kind == b"c":
            begin = c.at
            _, d, m, full = c.fields("<iiii")
            if full:
                raise FormatError("a state with full covariances")
            c.numbers(m * (12 + 16 * d), "u1")
            own.append(Mixture(*mixture_of(raw[begin : c.at])))
        elif kind == b"s":
            own.append(c.numbers(c.fields("<i")[0], "<f8"))
            books.add(c.fields("<i")[0])
        else:
            raise FormatError(f"unknown kind of state {kind!r}")
    c.end()
    if len(kinds) != 1 or len(books) > 1:
        raise FormatError("states of several kinds or codebooks")
    if kinds == {b"d"}:
        return Chain(initial, moves, np.array(own))
    plain = Chain(initial, moves, np.ones((n, 1)))
    if kinds == {b"c"}:
        return FrameChain.of_mixtures(plain, own)
    return FrameChain.of_codebook(plain, (codebooks or Codebooks({}))[books.pop()], np.array(own))
