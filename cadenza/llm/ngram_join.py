"""N-gram Jaccard self-join by vertical partitioning, answered as components of linked texts.

The global order of the n-grams is the order of their 64-bit hashes. It is cut into fragments twice.

*Sets that may link.* They have a signature in common (below), and at least the share ``t`` of each one's n-grams. So sets without a
signature that another set has are left out first, then sets of whose n-grams other such sets hold fewer.

*Candidates.* Sizes are dealt into levels ``[lo, hi]`` with ``hi = lo / t``; two linked sets differ in at most
``d = (1 - t) / (1 + t) * (a + b)`` n-grams, so of ``d + 1`` fragments one at least is the same in both (pigeonhole). Each set
therefore gives one signature per filled fragment, for its own level and for the lower levels from which a smaller partner may
come. Empty fragments would use up that guarantee, so a level is cut into ``d + 1 + e`` fragments, where nearly all of its sets have
``e`` empty ones or fewer; a set with more adds the cut for ``2 e``, ``4 e`` and so on until it has at most so many. Of two linked
sets, the one that stops first proves the pair's common fragment.
Where a threshold below 0.62 allows more differences than a set has n-grams, each n-gram is a signature.
Nothing is capped and no frequent n-gram is left out.

Sets are told apart by a 64-bit digest, which is expected to confuse 2.7 pairs of 10^10 distinct texts.

*Counting.* The sets of candidates are cut into ``fragments`` ranges; overlaps are counted for each (pair, fragment) separately
and summed per pair.

*Large groups.* Pairs are not expanded. The holders of each signature are compared with one of them, the pivot, which is the one
that shares most signatures with others. What remains to be found are links between holders of different components. With
``D(x)`` the n-grams in which x and the pivot p differ, ``|x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|``, so x and y link only if they share
at least ``(|D(x)| + |D(y)| - c (|x| + |y|)) / 2`` of these differences, ``c = (1 - t) / (1 + t)``. Those of x and y that are both near p are
connected already, and for the others this number is positive: a prefix join over the differences, rarest first, finds
them (pairs whose prefixes share too few for it are left out). No link that would connect two components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.components import components
from cadenza.llm.shared import Tables, bounded, give_back, join_hot, small_batches, written
from cadenza.llm.shingles import mix, shingle_sets

_LEVELS = 4_000_000_000
#: The bits of a set's digest that travel.
_MASK = (1 << 40) - 1
#: Shingles for which a bucket of signatures is made, buckets at most, and signatures that a task packs or folds at once.
PER_BUCKET, BUCKETS, AT_ONCE = 2_000_000, 1 << 23, 1_000_000
#: Sets for which a part of their counts is made.
PER_PART = 20_000


def _levels(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(lows, highs) of the size levels for the threshold ``num / den``."""
    lows, highs, lo = [], [], 1
    while lo < _LEVELS:
        hi = max(lo, lo * den // num)
        lows.append(lo)
        highs.append(hi)
        lo = hi + 1
    return np.array(lows), np.array(highs)


@cache
def _spare(low: int, differ: int) -> int:
    """Empty fragments to allow for at first: as many as nearly all sets of ``low`` n-grams have."""
    for extra in range(low):
        cut = differ + 1 + extra
        empty = cut * math.exp(-low / cut)
        if empty + 2 * math.sqrt(empty) <= extra + 0.5:
            return extra
    return 0  # too few n-grams to tell: they start from none


def signatures(grams: np.ndarray, num: int, den: int, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """All fragment signatures of one sorted set; equal fragments of one cut of one level have equal signatures."""
    n, out = len(grams), []
    mixed, top = mix(grams), grams >> np.uint64(32)
    level = int(np.searchsorted(lows, n, "right")) - 1
    while level >= 0 and n * num <= int(highs[level]) * den:
        hi = int(highs[level])
        differ = (hi + hi * den // num) * (den - num) // (den + num)
        extra = 0 if lows[level] <= differ else _spare(int(lows[level]), differ)
        if lows[level] <= differ:  # low thresholds: all n-grams may be in different fragments, so each is a signature
            out.append(mix(mixed ^ np.uint64(level)))
            differ = 0
        while differ:
            cut = differ + 1 + extra
            part = (top * np.uint64(cut)) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            seed = np.uint64(level) << np.uint64(48) ^ np.uint64(extra) << np.uint64(32)
            out.append(mix(np.add.reduceat(mixed, at) ^ mix(part[at] ^ seed)))
            if cut - len(at) <= extra:
                break
            extra = max(1, 2 * extra)
        level -= 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _digest(grams: np.ndarray) -> int:
    mixed = mix(grams)
    with np.errstate(over="ignore"):
        return int(mix(np.array([mixed.sum() ^ mix(np.bitwise_xor.reduce(mixed)[None])[0]], np.uint64)).view(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        ids = batch.column(0)
        for row, grams in shingle_sets(batch.column(1), k):
            yield ids[row].as_py(), grams


def _flush(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, schema, strict=True)], schema=schema)


def _size_rows(k: int):
    def run(batches):
        for batch in batches:
            n, v = [], []
            for _, grams in shingle_sets(batch.column(1), k):
                n.append(len(grams))
                v.append(_digest(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(v, pa.int64())], ["id", "n", "v"])

    return run


def _packed_rows(k: int, keys_of, buckets: int, parts: int, at_once: int = AT_ONCE):
    """Keys of distinct sets, packed by bucket: 40 further bits of each key and 40 bits of its set's digest, 10 bytes at any scale.

    A bucket holds about two million keys, so 40 bits confuse one in 500,000 of them, which only lets through what counting refutes.
    Two sets of one 40-bit digest (a chance of 10^-12 for a pair that links) would not count as two.

    A key that several sets have within one pack is shared already: it is sent once, without owners, and what it gives its sets goes
    along in rows of negative buckets (see :func:`_shared_rows`). So a frequent key costs its bucket one entry a pack.
    """
    schema = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("owners", pa.binary())])

    def packed(sigs: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        sig = np.concatenate(sigs)
        owner = np.repeat(np.array(owners, np.int64), [len(s) for s in sigs])
        order = np.argsort(sig)
        sig, owner = sig[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        times = np.diff(np.append(at, len(sig)))
        spread = (sig[at] >> np.uint64(32)) * np.uint64(buckets)
        bucket = (spread >> np.uint64(32)).astype(np.int32)
        rest = ((spread & np.uint64(0xFFFFFFFF)) << np.uint64(8)) | (sig[at] & np.uint64(0xFF))
        rows, often = [[], [], []], times > 1
        for some, owned in ((np.flatnonzero(~often), True), (np.flatnonzero(often), False)):
            if len(some):
                for s, e in _runs(bucket[some]):
                    for c, x in zip(rows, (bucket[some[s]], _narrow(rest[some[s:e]]), _narrow(owner[at[some[s:e]]]) if owned else b""), strict=True):
                        c.append(x)
        held = np.repeat(often, times)
        if parts and held.any():
            for part, sets, numbers in _counted(owner[held] & _MASK, parts):
                for c, x in zip(rows, (-1 - part, sets, numbers), strict=True):
                    c.append(x)
        elif held.any():
            whole = np.repeat(rest | (bucket.astype(np.uint64) << np.uint64(40)), times)[held]
            for c, x in zip(rows, (-1 - int(whole[0] % np.uint64(4096)), whole.tobytes(), _narrow(owner[held])), strict=True):
                c.append(x)
        return _flush(rows, schema)

    def run(batches):
        seen: set[int] = set()  # copies within the task, at most one entry for each of its rows
        sigs, owners, held = [], [], 0
        for _, grams in _sets(batches, k):
            if not len(grams) or (v := _digest(grams)) in seen:
                continue
            seen.add(v)
            sigs.append(keys_of(grams))
            owners.append(v)
            held += len(sigs[-1])
            if held >= at_once:
                yield packed(sigs, owners)
                sigs, owners, held = [], [], 0
        if held:
            yield packed(sigs, owners)
        give_back()

    return run


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist()
    return list(zip(starts, [*starts[1:], len(values)], strict=True))


def _counted(sets: np.ndarray, parts: int) -> list[tuple[int, bytes, bytes]]:
    """(part, sets, numbers): how often each set occurs, packed by part; the sets are sorted by part once and cut."""
    found, often = np.unique(sets, return_counts=True)
    place = found % parts
    order = np.argsort(place, kind="stable")
    found, often, place = found[order], often[order].astype("<i4"), place[order]
    return [(int(place[s]), _narrow(found[s:e]), often[s:e].tobytes()) for s, e in _runs(place)] if len(found) else []


def _narrow(x: np.ndarray) -> bytes:
    """The lower 40 bits of each value."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.int64).ravel()


def _fold(first: tuple[np.ndarray, np.ndarray, np.ndarray], sig: np.ndarray, v: np.ndarray):
    """(signatures with the first set seen of each and whether it was given out, signatures and sets to give out).

    A set below 0 stands for several that have been given out.
    """
    keys, sets = np.concatenate([first[0], sig]), np.concatenate([first[1], v])
    known, given = np.arange(len(keys)) < len(first[0]), np.concatenate([first[2], np.zeros(len(sig), bool)])
    order = np.argsort(keys, kind="stable")
    keys, sets, known, given = keys[order], sets[order], known[order], given[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    run = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    other = sets != sets[at][run]
    shared = np.bincount(run, other, minlength=len(at)) > 0
    out = (other | (new & shared[run] & ~given)) & (sets >= 0)
    return (keys[at], sets[at], given[at] | shared), keys[out], sets[out]


def _shared_rows(parts: int):
    """(sig, o) of the keys that two sets or more have, o for 40 bits of a set; rows in the order of their buckets.

    With ``parts``, instead packed numbers of such keys by set: (part, sets, numbers), a row per part and fold of a bucket.

    What is kept for a bucket is its distinct keys, each with one set: the holders of a frequent one pass through. So do rows of negative
    buckets, which hold such results of the tasks before.
    """

    def run(batches):
        yield from _folded(batches, parts)
        give_back()

    return run


def _folded(batches, parts: int):
    def nothing():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    bucket, first, waiting, held = None, nothing(), [], 0

    def folded():
        nonlocal first, waiting, held
        sig, v = (np.concatenate(x) for x in zip(*waiting, strict=True))
        first, keys, sets = _fold(first, sig, v)
        waiting, held = [], 0
        if parts:
            return _flush([list(c) for c in zip(*_counted(sets, parts), strict=True)] or [[], [], []], _COUNTS)
        both = np.unique(np.rec.fromarrays([(keys | (np.uint64(bucket) << np.uint64(40))).view(np.int64), sets]))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both["f0"])), pa.array(np.ascontiguousarray(both["f1"]))], ["sig", "o"])

    for batch in batches:
        for at, sigs, owners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at < 0:  # known before the shuffle
                yield _flush([[-1 - at], [sigs], [owners]], _COUNTS) if parts else pa.RecordBatch.from_arrays([pa.array(np.frombuffer(sigs, np.int64)), pa.array(_wide(owners))], ["sig", "o"])
                continue
            if at != bucket:
                if waiting:
                    yield folded()
                bucket, first = at, nothing()
            keys = _wide(sigs).view(np.uint64)
            waiting.append((keys, _wide(owners) if owners else np.full(len(keys), -1, np.int64)))
            held += len(waiting[-1][0])
            if held >= AT_ONCE:
                yield folded()
    if waiting:
        yield folded()


_COUNTS = pa.schema([("part", pa.int32()), ("sets", pa.binary()), ("numbers", pa.binary())])


def _summed_counts(batches):
    """(o, n): the numbers of :func:`_shared_rows` summed by set, rows in the order of their parts; a part's sets are held."""
    part, waiting, held, room = None, [], 0, AT_ONCE

    def summed():
        sets, numbers = (np.concatenate(x) for x in zip(*waiting, strict=True))
        sets, place = np.unique(sets, return_inverse=True)
        return sets, np.bincount(place, numbers, minlength=len(sets)).astype(np.int64)

    for batch in batches:
        for at, some, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != part and waiting:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["o", "n"])
                waiting, held, room = [], 0, AT_ONCE
            part = at
            waiting.append((_wide(some), np.frombuffer(numbers, "<i4")))
            held += len(waiting[-1][0])
            if held >= room:
                waiting = [summed()]
                held = len(waiting[0][0])
                room = max(AT_ONCE, 2 * held)  # each entry is sorted a few times, not once a row
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["o", "n"])


def _pack(grams: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: two sets of 20,000 n-grams confuse one with a probability of about 1e-6."""
    return (grams >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _fragment_rows(k: int, fragments: int):
    schema = pa.schema([("v", pa.int64()), ("n", pa.int64()), ("frag", pa.int32()), ("grams", pa.binary())])

    def run(batches):
        rows, held = [[], [], [], []], 0
        for _, grams in _sets(batches, k):
            v, part = _digest(grams), ((grams >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(fragments + 1, dtype=np.uint64))
            for f in range(fragments):
                for c, x in zip(rows, (v, len(grams), f, _pack(grams[cuts[f] : cuts[f + 1]])), strict=True):
                    c.append(x)
            held += len(grams)
            if held >= 500_000:
                yield _flush(rows, schema)
                rows, held = [[], [], [], []], 0
        if held:
            yield _flush(rows, schema)

    return run


def _overlap_rows(batches):
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        last, grams, common = None, None, []
        for a, b in zip(left, right, strict=True):
            if b is not last:
                last, grams = b, _unpack(b)
            x = _unpack(a)
            both = np.concatenate([x, grams])
            both.sort(kind="stable")
            common.append(int((both[1:] == both[:-1]).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), batch.column(4), batch.column(5)], ["x", "y", "common", "nx", "ny"])


def _difference_rows(batches):
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        last, grams, common, differ = None, None, [], []
        for a, b in zip(left, right, strict=True):
            if b is not last:
                last, grams = b, _unpack(b)
            both = np.concatenate([_unpack(a), grams])
            both.sort(kind="stable")
            same = both[1:] == both[:-1]
            alone = np.ones(len(both), bool)
            alone[1:] &= ~same
            alone[:-1] &= ~same
            common.append(int(same.sum()))
            differ.append(both[alone].astype(np.int64))
        ends = np.concatenate([[0], np.cumsum([len(d) for d in differ])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(differ) if differ else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), batch.column(4), batch.column(5), lists], ["x", "y", "common", "nx", "ny", "differ"])


def _by_fragment(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("v").alias("x"), F.col("n").alias("nx"), "frag", F.col("grams").alias("gx"))
    right = sets.select(F.col("v").alias("y"), F.col("n").alias("ny"), "frag", F.col("grams").alias("gy"))
    return pairs.join(left, "x").join(right, ["y", "frag"]).select("x", "y", "gx", "gy", "nx", "ny")


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("x", "y").agg(F.sum("common").alias("common"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with the size of their intersection, counted by fragment and summed: x, y, common, nx, ny."""
    return _summed(_by_fragment(pairs, sets).mapInArrow(_overlap_rows, "x long, y long, common long, nx long, ny long"))


def _open_pairs(stars: DataFrame, differences: DataFrame, roots: DataFrame, num: int, den: int, tables: Tables) -> DataFrame:
    """Pairs (x, y) of different components that may link, from their differences to a common pivot.

    stars: x, y (the pivot), common, nx, ny; differences: x, y, differ (by fragment); roots: id, root. A pivot may have a large
    part of all rows: only small tables are joined by it alone.
    """
    c = (den - num) / (den + num)
    root_of = roots.select(F.col("id").alias("x"), F.col("root").alias("rx"))
    pivot_root = roots.select(F.col("id").alias("y"), F.col("root").alias("ry")).join(stars.select("y").distinct(), "y", "left_semi")
    members = join_hot(stars.join(root_of, "x", "left"), pivot_root, "y", "x", "left").select(
        "x", "y", "nx", (F.col("nx") + F.col("ny") - 2 * F.col("common")).alias("d"), F.col("ny").alias("np"), F.coalesce("rx", "x").alias("rx"), (F.coalesce("rx", "x") != F.coalesce("ry", "y")).alias("minor")
    )
    members = tables.keep(members, "ngram-members")
    split = members.groupBy("y").agg(F.max("minor").alias("split")).filter("split").select("y")
    members = tables.keep(join_hot(members, split, "y", "x"), "ngram-split")

    each = differences.join(bounded(members.select("x", "y")), ["x", "y"]).select("x", "y", F.explode("differ").alias("e"))
    often = tables.keep(each.groupBy("y", "e").agg(F.count("*").alias("df")).filter("df > 1"), "ngram-often")
    ranked = each.join(bounded(often), ["y", "e"]).groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("shared"))
    # The rarest differences are those that nobody shares; what the prefix has beyond them is listed.
    widest = F.floor(c * (F.col("nx") + F.floor(F.col("nx") * den / num)))
    slack = 1e-6
    least_minor = F.greatest(F.lit(1), F.col("d") - widest)
    least_any = F.greatest(F.lit(1), F.ceil((F.col("d") + c * (F.col("np") - F.col("nx"))) / 2 - slack))

    def length(least):
        return F.col("d") - least + 1

    def prefix(least):
        n = F.greatest(F.lit(0), length(least) - (F.col("d") - F.size("shared")))
        return F.slice("shared", F.lit(1), n.cast("int"))

    listed = ranked.join(members, ["x", "y"]).select("x", "y", "nx", "d", "rx", "minor", F.size("shared").alias("s"), prefix(least_any).alias("any"), (F.col("d") - length(least_any)).alias("any_rest"), F.when(F.col("minor"), prefix(least_minor)).alias("wide"), (F.col("d") - length(least_minor)).alias("wide_rest"))
    listed = tables.keep(listed, "ngram-prefixes")
    a = listed.filter("minor").select("y", F.col("x").alias("a"), F.col("nx").alias("na"), F.col("d").alias("da"), F.col("rx").alias("ra"), F.element_at("wide", -1).alias("last_a"), F.col("wide_rest").alias("rest_a"), F.col("s").alias("sa"), F.posexplode("wide.e").alias("pa", "e"))
    b = listed.select("y", F.col("x").alias("b"), F.col("nx").alias("nb"), F.col("d").alias("db"), F.col("rx").alias("rb"), F.col("minor").alias("mb"), F.element_at("any", -1).alias("last_b"), F.col("any_rest").alias("rest_b"), F.col("s").alias("sb"), F.posexplode("any.e").alias("pb", "e"))
    may = (F.col("ra") != F.col("rb")) & (~F.col("mb") | (F.col("a") < F.col("b"))) & (F.abs(F.col("da") - F.col("db")) <= c * (F.col("na") + F.col("nb")) + slack)
    may = may & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    # What both share stands before this difference in both orders, or behind it in both; what nobody else has can't be shared.
    needed = (F.col("da") + F.col("db") - c * (F.col("na") + F.col("nb"))) / 2 - slack
    may = may & (F.least("pa", "pb") + F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= needed)
    # Shared differences are in both prefixes or beyond the one that ends first in the common order.
    rest = F.when(F.col("last_a") < F.col("last_b"), F.col("rest_a")).when(F.col("last_a") > F.col("last_b"), F.col("rest_b")).otherwise(F.least("rest_a", "rest_b"))
    spare = (needed - rest).alias("spare")
    met = a.join(b, ["y", "e"]).filter(may).groupBy("y", "a", "b").agg(F.count("*").alias("met"), F.first(spare).alias("spare")).filter("met >= spare")
    return met.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()


def ngram_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (8, 10), fragments: int = 4
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two rows link when ``intersection / union >= threshold`` (a fraction of integers) of their sets of ``k``-word shingles. Null
    texts and texts without words have no shingle and link with nothing; equal sets always link; repeated rows and null ids are
    kept (a null id never becomes a component's id, unless it has no other). Other columns are not read, so their names are free.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    small_batches(spark)
    num, den = threshold
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = tables.keep(texts.mapInArrow(_size_rows(k), T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("v", T.LongType())])), "ngram-sizes")

    own = sizes.filter("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.first("n").alias("size")).withColumn("o", F.col("v").bitwiseAND(F.lit(_MASK)))
    lows, highs = _levels(num, den)

    def signed(grams: np.ndarray) -> np.ndarray:
        return signatures(grams, num, den, lows, highs)

    def shared(rows: DataFrame, keys_of, total: int, parts: int) -> DataFrame:
        packed = rows.mapInArrow(_packed_rows(k, keys_of, min(BUCKETS, 1 + total // PER_BUCKET), parts), "bucket int, sigs binary, owners binary")
        found = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_rows(parts), "part int, sets binary, numbers binary" if parts else "sig long, o long")
        return found.repartition("part").sortWithinPartitions("part").mapInArrow(_summed_counts, "o long, n long") if parts else found

    def rows_of(some: DataFrame) -> DataFrame:
        # Rows without an id can't be found by it: all of them are looked at.
        return texts.join(bounded(some.select("id")), "id", "left_semi").unionByName(texts.filter("id is null"))

    # Sets with a signature that another one has; of those, sets that share enough of their n-grams with others of those.
    grams, rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = 1 + rows // PER_PART
    meet = shared(texts, signed, grams, parts).select("o")
    some = tables.keep(own.join(meet, "o", "left_semi"), "ngram-meet")
    common = shared(rows_of(some), lambda grams: grams, some.agg(F.sum("size")).first()[0] or 0, parts).select("o", F.col("n").alias("common"))
    chosen = tables.keep(some.join(common, "o").filter(F.col("common") * den >= F.col("size") * num).select("v", "o", "id", "size"), "ngram-chosen")
    of = rows_of(chosen)
    held = shared(of, signed, chosen.agg(F.sum("size")).first()[0] or 0, 0).join(bounded(chosen.select("o", "v")), "o").select("sig", "v")
    # The copies of a set meet here, so that each holder is one row.
    held = tables.keep(held.distinct(), "ngram-held")
    among = held.groupBy("sig").agg(F.count("*").alias("c"))
    known = tables.keep(held.join(among, "sig").groupBy("v").agg(F.sum("c").alias("known")), "ngram-known")
    pivots = tables.keep(held.join(known, "v").groupBy("sig").agg(F.max_by("v", F.struct("known", "v")).alias("pivot")), "ngram-pivots")

    sets = tables.keep(of.mapInArrow(_fragment_rows(k, fragments), "v long, n long, frag int, grams binary").join(bounded(known.select("v")), "v", "left_semi").dropDuplicates(["v", "frag"]), "ngram-sets")

    linked = F.col("common") * (den + num) >= num * (F.col("nx") + F.col("ny"))
    stars = held.join(pivots, "sig").filter("v <> pivot").select(F.col("v").alias("x"), F.col("pivot").alias("y")).distinct()
    stars = tables.keep(stars, "ngram-pairs")
    tables.drop("ngram-held", "ngram-known", "ngram-pivots", "ngram-chosen")
    differences = tables.keep(_by_fragment(stars, sets).mapInArrow(_difference_rows, "x long, y long, common long, nx long, ny long, differ array<long>"), "ngram-differences")
    starred = tables.keep(_summed(differences), "ngram-stars")
    links = starred.filter(linked).select("x", "y")
    near = tables.keep(components(links), "ngram-near")
    more = tables.keep(overlaps(_open_pairs(starred, differences, near, num, den, tables), sets).filter(linked).select("x", "y"), "ngram-links")
    joined = near if more.isEmpty() else tables.keep(components(links.unionByName(more)), "ngram-joined")

    # A set may have most rows, and so may a component: neither is a key that its rows meet by.
    home = join_hot(sizes, joined.select(F.col("id").alias("v"), "root"), "v", "id", "left").select("id", "n", F.coalesce("root", "v").alias("root"))
    home = tables.keep(home, "ngram-home")
    least = tables.keep(home.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").select("root", "least"), "ngram-least")
    found = written(join_hot(home, least, "root", "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id")), "ngram-components")
    tables.drop()
    return found
