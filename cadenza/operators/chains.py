"""Hidden Markov chains over frames of records of any length, with mixtures of the states' own or one shared codebook.

A record is cut into chunks of a bounded number of frames. What a chunk does to any state before it is a small matrix, whatever the
states are, so all chunks are worked on side by side; the matrices of a record are multiplied in a tree, ``fan`` to a task, and what
comes before and after each chunk goes down the same tree. No record is ever in one row, one group or one task.

Frames are rec_id, frame_idx (from 0, in any order), x. Frames without x are left out, records without frames have no row, records that
the chain can't produce have a score of minus infinity and say nothing in training. Logarithms throughout: no state underflows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.shared import rewritten
from cadenza.operators.models import Chain, Mixture

#: Frames of a chunk; matrices or chunks that one group of the tree holds.
FRAMES, FAN = 256, 256
#: Components times dimensions times frames that are scored at once.
_CELLS = 1 << 21


@dataclass(frozen=True)
class FrameChain:
    """initial [S], transitions [S, S], weights [S, C], means and variances [C, d].

    A component of weight 0 is none of the state's: own mixtures are blocks of weights, a shared codebook is a full matrix.
    """

    initial: np.ndarray
    transitions: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    @staticmethod
    def of_mixtures(chain: Chain, states: list[Mixture]) -> FrameChain:
        weights, at = np.zeros((len(states), sum(len(m.weights) for m in states))), 0
        for s, m in enumerate(states):
            weights[s, at : at + len(m.weights)] = m.weights
            at += len(m.weights)
        return FrameChain(chain.initial, chain.transitions, weights, np.concatenate([m.means for m in states]), np.concatenate([m.variances for m in states]))

    @staticmethod
    def of_codebook(chain: Chain, codebook: Mixture, weights: np.ndarray) -> FrameChain:
        return FrameChain(chain.initial, chain.transitions, np.asarray(weights, float), codebook.means, codebook.variances)

    def mixture(self, state: int) -> Mixture:
        own = self.weights[state] > 0
        return Mixture(self.weights[state, own], self.means[own], self.variances[own])

    def moves(self) -> np.ndarray:
        """[S + 1, S] logarithms of transitions; the last row is the start of a record."""
        with np.errstate(divide="ignore"):
            return np.log(np.concatenate([self.transitions, self.initial[None]]))

    def densities(self, x: np.ndarray) -> np.ndarray:
        """[frame, component] log densities."""
        out, step = np.empty((len(x), len(self.means))), max(1, _CELLS // self.means.size)
        constant = np.log(2 * np.pi * self.variances).sum(1)
        for at in range(0, len(x), step):
            apart = (x[at : at + step, None] - self.means) ** 2 / self.variances
            out[at : at + step] = -0.5 * (apart.sum(2) + constant)
        return out

    def emissions(self, densities: np.ndarray) -> np.ndarray:
        """[frame, state] from [frame, component]; a state of no components emits nothing."""
        out = np.full((len(densities), len(self.weights)), -np.inf)
        for s, w in enumerate(self.weights):
            if (w > 0).any():
                out[:, s] = _log_sum(densities[:, w > 0] + np.log(w[w > 0]), 1)
        return out

    def updated(self, s: dict[str, np.ndarray], least_occupancy: float, least_variance: float) -> FrameChain:
        """The chain that the sums ``s`` of a turn give."""
        seen = s["occ"].sum(0)[:, None]
        ok = seen > least_occupancy
        mean = np.where(ok, s["sum"] / np.where(ok, seen, 1.0), self.means)
        variance = np.where(ok, np.maximum(s["square"] / np.where(ok, seen, 1.0) - mean**2, least_variance), self.variances)
        return FrameChain(_shares(s["first"], self.initial), _shares(s["moves"], self.transitions), _shares(s["occ"], self.weights), mean, variance)


class SymbolChain(FrameChain):
    """A chain whose states show symbols: x is an array of one, the symbol's number, and weights are [S, symbols].

    Numbers that aren't symbols can't be shown by any state, so their records have a score of minus infinity.
    """

    @staticmethod
    def of(chain: Chain) -> SymbolChain:
        n = chain.emissions.shape[1]
        return SymbolChain(chain.initial, chain.transitions, chain.emissions, np.arange(n, dtype=float)[:, None], np.ones((n, 1)))

    def chain(self) -> Chain:
        return Chain(self.initial, self.transitions, self.weights)

    def densities(self, x: np.ndarray) -> np.ndarray:
        return np.where(x == self.means[:, 0], 0.0, -np.inf)

    def updated(self, s: dict[str, np.ndarray], least_occupancy: float, least_variance: float) -> SymbolChain:
        return SymbolChain.of(Chain(_shares(s["first"], self.initial), _shares(s["moves"], self.transitions), _shares(s["occ"], self.weights)))


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    top[~np.isfinite(top)] = 0.0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def _max(a: np.ndarray, axis: int) -> np.ndarray:
    return a.max(axis)


def chunked(frames: DataFrame, size: int = FRAMES) -> DataFrame:
    """rec_id, at, places, x: up to ``size`` frames a row, in order, x as one array; written, as every turn reads it."""
    if size < 1:
        raise ValueError("a chunk has one frame at least")
    place = F.when(F.col("frame_idx") >= 0, F.floor(F.col("frame_idx") / size)).otherwise(F.raise_error(F.lit("frame_idx is 0 or more")).cast("long"))
    listed = frames.filter("x is not null").groupBy("rec_id", place.alias("at")).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))).alias("f"))
    return rewritten(listed.select("rec_id", "at", F.transform("f", lambda c: c["frame_idx"]).alias("places"), F.flatten(F.transform("f", lambda c: c["x"])).alias("x")), "chunks")


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([v.tolist() for v in values], pa.list_(kind))


def _rows(values: np.ndarray) -> pa.Array:
    """A list a row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _side_by_side(chunks: pa.Array, d: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, lengths, frames [row, time, d]) of chunks of similar lengths, longest first; what a chunk lacks are copies of its last frame.

    They are as many as keep ``cells`` values a frame within bounds.
    """
    at, values = np.asarray(chunks.offsets), np.asarray(chunks.values.to_numpy(zero_copy_only=False), np.float64)
    lengths = np.diff(at) // d
    order, i = np.argsort(-lengths, kind="stable"), 0
    while i < len(order):
        longest = int(lengths[order[i]])
        rows = order[i : i + max(1, _CELLS // (4 * longest * max(cells, d)))]
        places = np.minimum(np.arange(longest), lengths[rows, None] - 1) * d + at[rows, None]
        yield rows, lengths[rows], values[places[:, :, None] + np.arange(d)]
        i += len(rows)


def _transfers(chunks: DataFrame, chain: FrameChain, best: bool) -> DataFrame:
    """rec_id, at, m: log weight, for each state before a chunk (or none) and at its end, of all paths or of the best one."""
    a, add, d = chain.moves(), _max if best else _log_sum, chain.means.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty((batch.num_rows, a.size))
            for rows, lengths, x in _side_by_side(batch.column(2), d, max(chain.weights.shape[1], a.size * a.shape[1])):
                e = chain.emissions(chain.densities(x.reshape(-1, d))).reshape(*x.shape[:2], -1)
                m = a + e[:, :1]
                for t in range(1, x.shape[1]):
                    k = int((lengths > t).sum())
                    m[:k] = add(m[:k, :, :, None] + a[:-1], 2) + e[:k, t, None]
                found[rows] = m.reshape(len(rows), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _rows(found)], ["rec_id", "at", "m"])

    kind = chunks.schema["rec_id"].dataType.simpleString()
    return chunks.select("rec_id", "at", "x").mapInArrow(run, f"rec_id {kind}, at long, m array<double>")


def _places(transfers: DataFrame, states: int, best: bool, forced: bool, fan: int) -> DataFrame:
    """rec_id, at, before, after, first, last, score of every chunk.

    before: log weights of the states before it (the last place: the record's start); after: of what follows, by the state at its end;
    first and last: the best path's states before it and at its end; score: the record's.
    """
    kind = transfers.schema["rec_id"].dataType.simpleString()
    add, shape = _max if best else _log_sum, (-1, states + 1, states)
    out = f"rec_id {kind}, at long, before array<double>, after array<double>, first int, last int, score double"
    names = ["rec_id", "at", "before", "after", "first", "last", "score"]

    def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by("at")
        return table, np.asarray(table.column("m").combine_chunks().flatten(), np.float64).reshape(shape)

    def forward(f: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.append(add(f[:, None] + m, 0), -np.inf)

    def members(table: pa.Table, f: np.ndarray, g: np.ndarray, last: int | None, score: float | None) -> pa.Table:
        table, each = ordered(table)
        before, after, firsts, lasts = [f], [g], [-1] * len(each), [-1] * len(each)
        for m in each:
            before.append(forward(before[-1], m))
        end = before.pop()[:-1]
        for m in each[:0:-1]:
            after.append(add(m[:-1] + after[-1], 1))
        if score is None:
            score = float(add(end + g, 0))
            last = int((end + g).argmax())
        if best:
            for i in range(len(each) - 1, -1, -1):
                lasts[i] = last
                firsts[i] = last = int((before[i] + each[i][:, last]).argmax())
        n = len(each)
        return pa.table([table.column("rec_id"), table.column("at"), _lists(before, pa.float64()), _lists(after[::-1], pa.float64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), pa.array([score] * n)], names)

    def start(table: pa.Table) -> pa.Table:
        f, g = np.full(states + 1, -np.inf), np.zeros(states)
        f[-1] = 0.0
        if forced:
            g[:-1] = -np.inf
        return members(table, f, g, None, None)

    def down(above: pa.Table, table: pa.Table) -> pa.Table:
        f, g, first, last, score = (above.column(c)[0].as_py() for c in names[2:])
        f = np.array(f)
        if best:  # what ties left open above is settled
            f = np.full(states + 1, -np.inf)
            f[first] = 0.0
        return members(table, f, np.array(g), last, score)

    def product(table: pa.Table) -> pa.Table:
        table, each = ordered(table)
        m = each[0]
        for other in each[1:]:
            m = add(m[:, :, None] + other[None, :-1], 1)
        return pa.table([table.column("rec_id")[:1], pa.array([table.column("at")[0].as_py() // fan]), _lists([m.ravel()], pa.float64())], ["rec_id", "at", "m"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As ``start``, for records of one matrix, all of a batch at once."""
        for batch in batches:
            m = np.asarray(batch.column(2).flatten(), np.float64).reshape(shape)
            f, g, n = np.full(states + 1, -np.inf), np.zeros(states), len(m)
            f[-1] = 0.0
            if forced:
                g[:-1] = -np.inf
            end = add(f[:, None] + m, 1) + g
            first = last = np.full(n, -1, np.int32)
            if best:
                last = end.argmax(1).astype(np.int32)
                first = (f + m[np.arange(n), :, last]).argmax(1).astype(np.int32)
            columns = [_rows(np.tile(f, (n, 1))), _rows(np.tile(g, (n, 1))), pa.array(first), pa.array(last), pa.array(add(end, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    levels = [rewritten(transfers, "transfers")]
    most = levels[0].agg(F.max("at")).first()[0] or 0
    up = F.floor(F.col("at") / fan)
    while most >= fan:
        levels.append(rewritten(levels[-1].groupBy("rec_id", up.alias("up")).applyInArrow(product, f"rec_id {kind}, at long, m array<double>"), "transfers"))
        most //= fan
    top = levels.pop()
    if most:
        top = rewritten(top.withColumn("n", F.count("*").over(W.partitionBy("rec_id"))), "transfers")
        placed = top.filter("n = 1").drop("n").mapInArrow(alone, out).union(top.filter("n > 1").drop("n").groupBy("rec_id").applyInArrow(start, out))
    else:
        placed = top.mapInArrow(alone, out)
    placed = rewritten(placed, "places")
    while levels:
        below = levels.pop()
        placed = rewritten(placed.groupBy("rec_id", "at").cogroup(below.groupBy("rec_id", up.alias("up"))).applyInArrow(down, out), "places")
    return placed


def _joined(chunks: DataFrame, placed: DataFrame) -> DataFrame:
    same = F.col("c.rec_id").eqNullSafe(F.col("p.rec_id")) & (F.col("c.at") == F.col("p.at"))
    return chunks.alias("c").join(placed.alias("p"), same).select("c.rec_id", "c.places", "c.x", "p.before", "p.after", "p.first", "p.last", "p.score")


def best_states(frames: DataFrame, chain: FrameChain, forced: bool = False, size: int = FRAMES, fan: int = FAN) -> DataFrame:
    """rec_id, frame_idx, q, score: the state of every frame on its record's best path, and the path's log score.

    ``forced`` ends in the last state. Of equally good paths one is taken, by the lowest state at the joins of chunks, then from their ends.
    """
    chunks, a, d = chunked(frames, size), chain.moves(), chain.means.shape[1]
    placed = _places(_transfers(chunks, chain, True), len(chain.initial), True, forced, _checked(fan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                e = chain.emissions(chain.densities(np.asarray(batch.column(2)[i].values, np.float64).reshape(-1, d)))
                first, q = batch.column(5)[i].as_py(), np.empty(len(e), np.int32)
                score, back = a[first] + e[0], np.zeros((len(e), len(a) - 1), np.int32)
                for t in range(1, len(e)):
                    each = score[:, None] + a[:-1]
                    back[t] = each.argmax(0)
                    score = each.max(0) + e[t]
                q[-1] = batch.column(6)[i].as_py()
                for t in range(len(e) - 1, 0, -1):
                    q[t - 1] = back[t, q[t]]
                rows = pa.array(np.full(len(e), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1)[i].values, pa.array(q), batch.column(7).take(rows)], ["rec_id", "frame_idx", "q", "score"])

    kind = chunks.schema["rec_id"].dataType.simpleString()
    return _joined(chunks, placed).mapInArrow(run, f"rec_id {kind}, frame_idx long, q int, score double")


def record_scores(frames: DataFrame, chain: FrameChain, best: bool = False, forced: bool = False, size: int = FRAMES, fan: int = FAN) -> DataFrame:
    """rec_id, score: each record's log likelihood, or with ``best`` that of its best path; ``forced`` paths end in the last state."""
    return scores_of_chunks(chunked(frames, size), chain, best, forced, fan)


def scores_of_chunks(chunks: DataFrame, chain: FrameChain, best: bool = False, forced: bool = False, fan: int = FAN) -> DataFrame:
    """As :func:`record_scores`, of frames that are :func:`chunked` already: for several chains."""
    placed = _places(_transfers(chunks, chain, best), len(chain.initial), best, forced, _checked(fan))
    return placed.groupBy("rec_id").agg(F.max("score").alias("score"))


def _checked(fan: int) -> int:
    if fan < 2:
        raise ValueError("fan is 2 or more")
    return fan


def _expected(joined: DataFrame, chain: FrameChain) -> dict[str, np.ndarray]:
    """Expected starts, moves, occupancies by state and component, moments by component, log likelihood and frames, added up by task."""
    a, (s_n, c_n), d = chain.moves(), chain.weights.shape, chain.means.shape[1]
    shapes = {"first": (s_n,), "moves": (s_n, s_n), "occ": (s_n, c_n), "sum": (c_n, d), "square": (c_n, d), "ll": (1,), "n": (1,)}

    def add(out: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray, f: np.ndarray, g: np.ndarray, score: np.ndarray) -> None:
        each = chain.densities(x.reshape(-1, d))
        e = chain.emissions(each).reshape(*x.shape[:2], -1)
        alpha, beta, alive = np.full_like(e, -np.inf), np.full_like(e, -np.inf), [int((lengths > t).sum()) for t in range(x.shape[1])]
        alpha[:, 0], beta[np.arange(len(x)), lengths - 1] = _log_sum(f[:, :, None] + a, 1) + e[:, 0], g
        for t, k in enumerate(alive[1:], 1):
            alpha[:k, t] = _log_sum(alpha[:k, t - 1, :, None] + a[:-1], 1) + e[:k, t]
        for t in range(len(alive) - 1, 0, -1):
            k = alive[t]
            into = a[:-1] + (e[:k, t] + beta[:k, t])[:, None]
            beta[:k, t - 1] = _log_sum(into, 2)
            out["moves"] += np.exp(alpha[:k, t - 1, :, None] + into - score[:k, None, None]).sum(0)
        into = np.exp(f[:, :, None] + a + (e[:, 0] + beta[:, 0])[:, None] - score[:, None, None]).sum(0)
        out["first"] += into[-1]
        out["moves"] += into[:-1]
        gamma = np.exp(alpha + beta - score[:, None, None]).reshape(-1, s_n)  # 0 where a chunk has no frame
        e, x = e.reshape(-1, s_n), x.reshape(-1, d)
        for s, w in enumerate(chain.weights):
            own = np.flatnonzero(w > 0)
            shown = np.where(np.isfinite(e[:, s]), e[:, s], 0.0)[:, None]  # what can't be shown has no weight
            share = gamma[:, s, None] * np.exp(each[:, own] + np.log(w[own]) - shown)
            out["occ"][s, own] += share.sum(0)
            out["sum"][own] += share.T @ x
            out["square"][own] += share.T @ (x * x)
        out["n"] += lengths.sum()
        out["ll"] += score[f[:, -1] == 0.0].sum()  # once a record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {k: np.zeros(shape) for k, shape in shapes.items()}
        for batch in batches:
            batch = batch.filter(pc.is_finite(batch.column(3)))
            f, g = (np.asarray(batch.column(i).flatten(), np.float64).reshape(-1, n) for i, n in ((1, s_n + 1), (2, s_n)))
            score = np.asarray(batch.column(3))
            for rows, lengths, x in _side_by_side(batch.column(0), d, max(c_n, 4 * s_n, a.size)):
                add(out, x, lengths, f[rows], g[rows], score[rows])
        flat = np.concatenate([v.ravel() for v in out.values()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    rows = joined.select("x", "before", "after", "score").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a model's size
    flat, out, at = np.zeros(sum(int(np.prod(s)) for s in shapes.values())), {}, 0
    for r in rows:
        flat[r["i"]] = r["v"]
    for k, shape in shapes.items():
        out[k] = flat[at : at + int(np.prod(shape))].reshape(shape)
        at += out[k].size
    return out


def _shares(counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Rows of counts as shares; a row of none keeps the old one."""
    whole = counts.sum(-1, keepdims=True)
    return np.where(whole > 0, counts / np.where(whole > 0, whole, 1.0), old)


def train(frames: DataFrame, chain: FrameChain, turns: int = 10, least_occupancy: float = 0.0, least_variance: float = 1e-3, size: int = FRAMES, fan: int = FAN, watch: Callable[[int, float], None] | None = None) -> tuple[FrameChain, list[float]]:
    """(re-estimated chain, log likelihood before each turn), by forward and backward weights over all records.

    Components of a shared codebook pool what all states say of them. Components of ``least_occupancy`` frames or less keep their place;
    variances are at least ``least_variance``. The likelihood doesn't fall unless a floor takes effect. A turn shuffles the chunks once.
    """
    chunks, lls = chunked(frames, size), []
    for turn in range(turns):
        placed = _places(_transfers(chunks, chain, False), len(chain.initial), False, False, _checked(fan))
        s = _expected(_joined(chunks, placed), chain)
        lls.append(float(s["ll"][0]))
        if watch:
            watch(turn, lls[-1])
        chain = chain.updated(s, least_occupancy, least_variance)
    return chain, lls
