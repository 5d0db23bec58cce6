"""Round trips of model files, and files that are cut or go on."""

import numpy as np
import pytest

from cadenza.operators import chains as H
from cadenza.operators.models import Chain, Mixture
from cadenza.sources import models as X
from cadenza.sources.formats import FormatError, mixture_bytes

RNG = np.random.default_rng(9)


def _single(a):
    return a.astype(np.float32).astype(float)


def test_nuisance_bases(tmp_path):
    basis = _single(RNG.normal(size=(3, 7)))
    X.save(f"file://{tmp_path}/a/b.nap", X.nuisance_bytes(basis))
    raw = X.load(f"file://{tmp_path}/a/b.nap")
    assert len(raw) == 8 + 3 * 7 * 4 and np.array_equal(X.nuisance_of(raw), basis)
    bases = [_single(RNG.normal(size=(n, 4))) for n in (1, 2, 3)]
    back = X.block_nuisance_of(X.block_nuisance_bytes(bases))
    assert all(np.array_equal(a, b) for a, b in zip(back, bases, strict=True))
    with pytest.raises(ValueError):
        X.block_nuisance_bytes([bases[0], basis])


def test_full_mixtures():
    w, m, p = RNG.random(2), RNG.normal(size=(2, 3)), RNG.normal(size=(2, 6))
    assert all(np.array_equal(a, b) for a, b in zip(X.full_mixture_of(X.full_mixture_bytes(w, m, p)), (w, m, p), strict=True))
    v = RNG.random((2, 3))
    _, _, packed = X.full_mixture_of(mixture_bytes(w, m, v))
    assert np.array_equal(packed[:, [0, 2, 5]], v) and not packed[:, [1, 3, 4]].any()


def test_chains_of_every_kind():
    moves, first = np.array([[0.5, 0.5], [0.25, 0.75]]), np.array([1.0, 0.0])
    plain = Chain(first, moves, RNG.random((2, 5)))
    back = X.states_of(X.states_bytes(plain))
    assert np.array_equal(back.emissions, plain.emissions) and np.array_equal(back.transitions, moves)
    own = H.FrameChain.of_mixtures(plain, [Mixture(np.array([0.5, 0.5]), RNG.normal(size=(2, 3)), RNG.random((2, 3))), Mixture(np.ones(1), RNG.normal(size=(1, 3)), RNG.random((1, 3)))])
    back = X.states_of(X.states_bytes(own))
    assert all(np.array_equal(getattr(back, f), getattr(own, f)) for f in ("initial", "transitions", "weights", "means", "variances"))
    book = Mixture(np.full(4, 0.25), RNG.normal(size=(4, 3)), RNG.random((4, 3)))
    shared = H.FrameChain.of_codebook(plain, book, RNG.random((2, 4)))
    raw = X.states_bytes(shared, codebook_id=6)
    back = X.states_of(raw, X.Codebooks({6: book}))
    assert np.array_equal(back.weights, shared.weights) and np.array_equal(back.means, book.means)
    with pytest.raises(FormatError, match="missing codebook 6"):
        X.states_of(raw)
    for bad in (raw[:-1], raw + b"x", raw.replace(b"s", b"q", 1)):
        with pytest.raises(FormatError):
            X.states_of(bad, X.Codebooks({6: book}))
