"""Conversation prefix trie: which conversations begin alike, and what sharing their beginnings saves.

A node is a distinct sequence of first turns, named by a digest: the xor of 128-bit hashes of (depth, role, text) over its turns, so the
parent's digest is the node's without its last turn's hash. Conversations meet at nodes by grouped aggregation. Sums over subtrees
come from pointer doubling: after round k a node holds the sums of its descendants nearer than 2**k and points to its ancestor 2**k
above; a round adds to each node the sums of those that point at it and follows the pointers once, so a trie of depth d takes
log2(d) rounds.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.shared import Tables, bounded, is_small, parts_of

#: Turns of a conversation that one group holds; longer ones are joined from such blocks.
BLOCK = 1024
#: Ids of conversations that one row holds on its way to a digest.
IDS = 4096
#: A key with this share of a table's rows is joined by broadcast; so many keys can have it at most.
HOT = 1024


def _lanes(*parts: Column) -> list[Column]:
    """Two 64-bit hashes of independent seeds."""
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def _key(depth: Column, a: Column, b: Column) -> Column:
    return F.struct(depth.cast("long").alias("depth"), a.alias("a"), b.alias("b"))


def turn_rows(conversations: DataFrame, tables: Tables, *, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos from 1, a, b, bytes) of each turn; a and b hash role and text. Rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    a, b = _lanes(role, text)
    turn = F.col(f"`{turn_col}`")
    slim = conversations.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("conv"), turn.alias("turn"), a.alias("a"), b.alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    slim = parts_of(slim, "conv", "turn", BLOCK).withColumnRenamed("part", "block")
    within = W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    placed = tables.keep(slim.select("conv", "block", "a", "b", "bytes", F.row_number().over(within).cast("long").alias("at")), "trie-turns")
    return _after_blocks(placed, "block", [("at", F.max("at"), F.sum)]).select("conv", F.col("at").alias("pos"), "a", "b", "bytes")


def _after_blocks(rows: DataFrame, block: str, carried: list) -> DataFrame:
    """``rows`` with what the earlier blocks of their conversation amount to taken into each carried column.

    ``carried`` has (column, aggregate of a block, aggregate over blocks: sum or bit_xor). Only conversations of several blocks are joined.
    """
    blocks = rows.groupBy("conv", block).agg(*[agg.alias(f"all_{c}") for c, agg, _ in carried])
    before = W.partitionBy("conv").orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    base = blocks.select("conv", block, *[over(f"all_{c}").over(before).alias(f"base_{c}") for c, _, over in carried]).filter(F.col(f"base_{carried[0][0]}").isNotNull())
    joined = rows.join(bounded(base), ["conv", block], "left")
    for c, _, over in carried:
        earlier = F.coalesce(f"base_{c}", F.lit(0).cast("long"))
        joined = joined.withColumn(c, F.col(c) + earlier if over is F.sum else F.col(c).bitwiseXOR(earlier)).drop(f"base_{c}")
    return joined


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, a, b, bytes): the first ``h`` turns of the conversation ``src``, then the own turns after the first ``h``.

    ``convs`` has a row (conv, n turns, src, h) for each conversation; a source that is absent lends nothing.
    """
    there = convs.select(F.col("conv").alias("src"), F.col("n").alias("src_n"))
    taken = convs.join(there, "src", "left").select("conv", "src", "h", F.least("h", F.coalesce("src_n", F.lit(0).cast("long"))).alias("lent"))
    most = convs.agg(F.max("h")).first()[0] or 0
    heads = turns.filter(F.col("pos") <= most).select(F.col("conv").alias("src"), "pos", "a", "b", "bytes")
    borrowed = taken.join(heads, "src").filter("pos <= lent").select("conv", F.col("pos").alias("depth"), "a", "b", "bytes")
    own = turns.join(taken.select("conv", "h", "lent"), "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), "a", "b", "bytes")
    return borrowed.unionByName(own)


def prefix_rows(sequences: DataFrame, tables: Tables) -> DataFrame:
    """(conv, key, parent, bytes) of every prefix of one turn or more; ``sequences`` has (conv, depth from 1, a, b, bytes)."""
    a, b = _lanes(F.col("depth"), F.col("a"), F.col("b"))
    hashed = sequences.select("conv", "depth", "bytes", a.alias("own_a"), b.alias("own_b"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    until = W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    within = tables.keep(hashed.select("*", F.bit_xor("own_a").over(until).alias("a"), F.bit_xor("own_b").over(until).alias("b")), "trie-prefixes")
    found = _after_blocks(within, "block", [("a", F.bit_xor("own_a"), F.bit_xor), ("b", F.bit_xor("own_b"), F.bit_xor)])
    parent = _key(F.col("depth") - 1, F.col("a").bitwiseXOR(F.col("own_a")), F.col("b").bitwiseXOR(F.col("own_b")))
    return found.select("conv", _key(F.col("depth"), F.col("a"), F.col("b")).alias("key"), parent.alias("parent"), "bytes")


def _follow(rows: DataFrame, by: str, targets: DataFrame, share: int) -> DataFrame:
    """``rows`` left-joined with ``targets`` (unique ``by``, and n, the rows that have it); keys of more than ``share`` rows by broadcast.

    Those are fewer than the rows over ``share``, so the broadcast is bounded whatever the table's size.
    """
    if is_small(targets.select(*targets.columns)):
        return rows.join(F.broadcast(targets.drop("n")), by, "left")
    hot = targets.filter(F.col("n") > share).drop("n").withColumn("hot", F.lit(True))
    rest = targets.filter(F.col("n") <= share).drop("n")
    marked = rows.join(F.broadcast(hot), by, "left")
    return marked.filter("hot").drop("hot").unionByName(marked.filter("hot is null").select(*rows.columns).join(rest, by, "left"))


def subtree_sums(nodes: DataFrame, tables: Tables, columns: list[str]) -> DataFrame:
    """(key, ``columns`` summed over the subtree of each of ``nodes``, itself included); ``nodes`` has key, parent and the columns.

    Only nodes with an ancestor 2**k above take part in round k; the others have sent all they have, and what they still receive is
    added up at the end.
    """
    count, deepest = nodes.agg(F.count("*"), F.coalesce(F.max("key.depth"), F.lit(0))).first()
    share, none = max(1, count // HOT), F.lit(0).cast("long")
    start = nodes.select("key", F.col("parent").alias("up"), *columns)
    still, active = [start.filter("up is null")], start.filter("up is not null")
    for k in range(int(deepest).bit_length()):
        sent = active.groupBy(F.col("up").alias("key")).agg(*[F.sum(c).alias(f"sent_{c}") for c in columns], F.count("*").alias("n"))
        both = active.join(sent, "key", "full_outer")
        summed = tables.keep(both.select("key", "up", *[(F.coalesce(c, none) + F.coalesce(f"sent_{c}", none)).alias(c) for c in columns], "n"), "trie-sums")
        targets = summed.filter("n is not null").select(F.col("key").alias("up"), F.col("up").alias("next"), "n")
        moved = _follow(summed.drop("n").filter("up is not null"), "up", targets, share).select("key", F.col("next").alias("up"), *columns)
        moved = tables.keep(moved, "trie-moved")
        still += [summed.filter("up is null").drop("n"), moved.filter("up is null")]
        active = moved.filter("up is not null")
    whole = still[0]
    for part in still[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("key").agg(*[F.sum(c).alias(c) for c in columns])


def _id_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv): the digest of the ids of a key, ascending, decimal, with commas between.

    Ids are packed by :data:`IDS` before they are shuffled. A key's packs are read in order and hashed one after another, so a
    key with most of all ids takes a task long, but no more memory than a pack.
    """
    packs = ends.groupBy("key", F.floor(F.col("conv") / IDS).alias("pack")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    packs = packs.repartition("key").sortWithinPartitions("key", "pack").select("key", "ids")

    def run(batches):
        held, digest = None, None
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for key, ids in zip(keys, batch.column(1), strict=True):
                text = ",".join(map(str, ids.as_py())).encode()
                if key != held:
                    if digest is not None:
                        out.append((held, digest.hexdigest()))
                    held, digest = key, hashlib.sha256(text)
                else:
                    digest.update(b"," + text)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema.field(0).type), pa.array([d for _, d in out], pa.string())], ["key", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], batch.schema.field(0).type), pa.array([digest.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return packs.mapInArrow(run, "key struct<depth: bigint, a: bigint, b: bigint>, ends_sha256 string")


def prefix_trie(sequences: DataFrame, convs: DataFrame, tables: Tables) -> DataFrame:
    """The trie of ``sequences`` (conv, depth from 1, a, b, bytes) of the conversations in ``convs`` (conv; also those without turns).

    A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 as the
    registered query has them, and key and parent, the digests. Without conversations there is no node, not even the root.
    """
    none = F.lit(0).cast("long")
    prefixes = prefix_rows(sequences, tables)
    roots = convs.select("conv", _key(none, none, none).alias("key"), F.lit(None).cast("struct<depth: bigint, a: bigint, b: bigint>").alias("parent"), none.alias("bytes"))
    members = tables.keep(prefixes.unionByName(roots), "trie-members")
    tables.drop("trie-turns", "trie-placed", "trie-prefixes", "trie-convs")
    nodes = members.groupBy("key").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"))
    nodes = tables.keep(nodes, "trie-nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = tables.keep(nodes.join(bounded(children), "key", "left").withColumn("n_children", F.coalesce("n_children", none)), "trie-edges")
    tables.drop("trie-nodes")

    own = nodes.select("key", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = subtree_sums(own, tables, ["n_leaves", "saved_tokens"])
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    named = _follow(nodes.filter("parent is not null"), "parent", parents, max(1, nodes.count() // HOT))
    named = named.unionByName(nodes.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))

    last = members.groupBy("conv").agg(F.max("key").alias("key"))
    digests = _id_digests(last.select("key", "conv"))
    whole = named.join(sums, "key").join(digests, "key", "left")
    return whole.select("conv_id", F.col("key.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "key", "parent")


def conversation_trie(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 1, most_shared: int = 0) -> DataFrame:
    """:func:`prefix_trie` of a table of turns, of conversations as they are or rebuilt with shared beginnings.

    Turns are ordered by ``turn_col``, null first; turns of one number by a hash of role and text, so equal rows stand together.
    With ``group`` > 1 every conversation c starts with the first ``crc32(c) % (most_shared + 1)`` turns of conversation ``c - c %
    group`` (all of them if it has fewer, none if there is none), followed by its own turns after as many. Null roles and texts count
    as empty. Rows without a conversation id belong to none and are left out; repeated rows are turns of their own. Texts of any
    length are hashed where they are read and are not shuffled. An empty table has no nodes. Columns other than the named ones play no part.

    One conversation may hold most turns: positions and digests are found in blocks of about :data:`BLOCK` turns, then
    shifted by what the earlier blocks amount to; only copies of a single turn number share a group, sorted with spilling.
    """
    tables = Tables(conversations.sparkSession)
    turns = tables.keep(turn_rows(conversations, tables, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "trie-placed")
    h = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % (most_shared + 1)
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = tables.keep(convs.select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("src"), h.cast("long").alias("h")), "trie-convs")
    sequences = rebuilt(turns, convs) if group > 1 else turns.withColumnRenamed("pos", "depth")
    return prefix_trie(sequences, convs.select("conv"), tables)
