"""Texts as rows of bytes cut into units, of which each distinct one is encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Distinct units that a task keeps with their ids; beyond, it starts anew.
KNOWN = 150_000


def take_units(raw: np.ndarray, offsets: np.ndarray, opens: np.ndarray, known: dict[str, bytes], encode: Callable[[list[str]], dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, where each row's begin and the last end). ``opens`` marks the bytes that begin a unit; rows always do."""
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    opens[0] = True
    opens[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(opens)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(np.ascontiguousarray(raw)))
    units = units.dictionary_encode()
    distinct = units.dictionary.to_pylist()
    if len(known) > KNOWN:
        known.clear()
    # As bytes: an array of a few ids would take twice the memory and keep alive what it was cut from.
    known |= {u: np.asarray(x, np.int32).tobytes() for u, x in encode([u for u in distinct if u not in known]).items()}
    found = [known[u] for u in distinct]
    ends = np.cumsum([0, *map(len, found)]) // 4
    lists = pa.LargeListArray.from_arrays(ends, np.frombuffer(b"".join(found), np.int32)).take(units.indices)
    ids, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    bounds = ends[np.searchsorted(starts, offsets)]
    return ids[bounds[0] : bounds[-1]], bounds - bounds[0]
