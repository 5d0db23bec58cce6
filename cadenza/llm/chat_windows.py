"""Chat formatting in budgeted windows: whole turns, the system turn in every window, limited history, a loss mask over new answers.

A turn is written ``[INST]role[/INST]text</s>``. Inside roles and texts these marks get a backslash after their first character, and
marks that have backslashes there get one more, so every text can be read back.

Prefix sums of turn sizes choose the windows: the new turns of a window are those within one stretch of ``room`` tokens; a turn that
crosses into another stretch joins the turns it reaches if they have room for it, else it has a window of its own. So only a single
turn that is larger than the room makes a window larger than the budget, and two neighbours never fit into one stretch both.

All of it is DataFrame functions; prefix sums come from windows over blocks of turns, windows from arrays of a block's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.shared import bounded, parts_of, written

OPEN, SAYS, END = "[INST]", "[/INST]", "</s>"
#: Turns that one group holds; a longer conversation continues in the next block, with the history that the last one hands on.
BLOCK = 512


def escaped(text: Column) -> Column:
    """``text`` without the template's marks, reversibly."""
    return F.regexp_replace(F.regexp_replace(text, r"\[(\\*/?INST\])", r"[\\$1"), r"<(\\*/s>)", r"<\\$1")


def unescaped(text: Column) -> Column:
    """The text that :func:`escaped` was given."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\\(\\*/?INST\])", "[$1"), r"<\\(\\*/s>)", "<$1")


def words(text: Column) -> Column:
    """Words of a text: the default size of a turn, to which its marks add 3."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def _blocks(turns: DataFrame, tokens: Column, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, block, turns): up to :data:`BLOCK` turns in order, each (at, role, piece, head, size, end); end is a prefix sum of sizes."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.col(f"`{turn_col}`")
    rows = turns.select(F.struct(F.col(f"`{id_col}`").alias("id")).alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.coalesce(tokens, F.lit(0)) + 3).cast("long").alias("size"))
    rows = parts_of(rows, "conv", "turn", BLOCK)
    order = W.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SAYS))
    rows = rows.select("conv", "part", "role", head.alias("head"), F.concat(head, escaped(F.col("text")), F.lit(END)).alias("piece"), "size", F.row_number().over(order).alias("at"), F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("end"))
    # The shuffle of the prefix sums serves here too: its keys are part of these.
    item = F.struct("at", "role", "piece", F.length("head").alias("head"), "size", "end", F.length("piece").alias("chars"))
    blocks = rows.groupBy("conv", "part", F.floor((F.col("at") - 1) / BLOCK).alias("sub")).agg(F.array_sort(F.collect_list(item)).alias("turns"))
    return blocks.select("conv", F.struct("part", "sub").alias("block"), "turns")


def _handed_on(blocks: DataFrame, history: int) -> DataFrame:
    """(conv, block, first, sys, tail): whether a block is its conversation's first, the system turn, and the last turns before the block.

    Only conversations of several blocks have rows here: a slim table, in which a block is a system turn and ``history`` tokens.
    """
    last = F.element_at("turns", -1)
    tail = F.filter("turns", lambda t: last["end"] - t["end"] + t["size"] <= history)
    slim = blocks.select("conv", "block", F.element_at("turns", 1).alias("head"), tail.alias("tail"))
    several = blocks.groupBy("conv").count().filter("count > 1").select("conv")
    order = W.partitionBy("conv").orderBy("block")
    head = F.first("head").over(order.rowsBetween(W.unboundedPreceding, 0))
    slim = slim.join(bounded(several), "conv", "left_semi").select("conv", "block", (F.row_number().over(order) == 1).alias("first"), head.alias("head"), F.lag("tail").over(order).alias("tail"), F.sum(F.lit(1)).over(order).alias("n"))
    # A system turn that is all of the first block's tail is repeated anyway.
    return slim.filter("n > 1").select("conv", "block", F.lit(False).alias("first"), F.when(F.col("head.role") == "system", F.col("head")).alias("sys"), F.filter("tail", lambda t: (F.col("n") > 2) | (t["at"] > 1) | (F.col("head.role") != "system")).alias("tail"))


def chat_windows(
    conversations: DataFrame,
    *,
    budget: int = 1024,
    history: int = 256,
    tokens: Column | None = None,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn_from: str = "assistant",
) -> DataFrame:
    """A row a window: ``id_col``, block, window (its number within the block), text, n_repeated, n_new, n_tokens, loss.

    Turns are ordered by ``turn_col`` (null first), then role and text; each is new in exactly one window. A window starts with the
    system turn (the conversation's first turn, if its role is ``system``) and with the turns before its new ones that fit into
    ``history`` tokens: n_repeated turns in all. loss has the code points [begin, end) of the window's text that are texts of the role
    ``learn_from`` among the new turns; repeated turns are not in it. n_tokens is at most ``budget``, unless a single new turn is larger than what
    the system turn and the history leave of it. ``tokens`` is the size of a turn (of columns of the input), by default its words; the marks add 3.

    Null roles and texts count as empty; rows without an id are one conversation; repeated rows are turns of their own. An empty table has no
    windows. Texts of any length stay whole. Other columns of the input play no part.

    A conversation may hold most turns: of one with more than :data:`BLOCK`, blocks are worked on by themselves (each begins a new window)
    and hand on the system turn and the last ``history`` tokens; copies of one turn number are sorted with spilling.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be within the budget")
    blocks = _blocks(conversations, words(F.col(f"`{text_col}`")) if tokens is None else tokens, id_col, turn_col, role_col, text_col)
    blocks = written(blocks, "chat-blocks")
    blocks = blocks.join(bounded(written(_handed_on(blocks, history), "chat-handed-on")), ["conv", "block"], "left")

    top = F.element_at("turns", 1)
    own = F.col("first").isNull() & (top["role"] == "system")  # the block begins with the system turn
    blocks = blocks.select("conv", "block", F.coalesce("sys", F.when(own, top)).alias("sys"), own.alias("own"), F.coalesce("tail", F.filter("turns", lambda t: F.lit(False))).alias("tail"), F.when(own, F.slice("turns", 2, BLOCK)).otherwise(F.col("turns")).alias("turns"))
    base = F.when(F.size("turns") > 0, F.element_at("turns", 1)["end"] - F.element_at("turns", 1)["size"])
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget - history).cast("long") - F.coalesce(F.col("sys.size"), F.lit(0)))
    blocks = blocks.select("*", F.coalesce(base, F.lit(0)).alias("base"), room.alias("room"))
    blocks = blocks.withColumn("places", F.transform("turns", _stretch))
    blocks = blocks.withColumn("starts", F.filter(F.sequence(F.lit(1), F.greatest(F.size("turns"), F.lit(1))), _begins))
    spans = F.transform("starts", lambda s, i: F.struct(i.alias("window"), s.alias("begin"), F.coalesce(F.get("starts", i + 1), F.size("turns") + 1).alias("end")))
    each = blocks.select("conv", "block", "sys", "own", "tail", "turns", F.explode(spans).alias("span"))

    new = F.slice("turns", F.col("span.begin"), F.col("span.end") - F.col("span.begin"))
    earlier = F.slice("turns", 1, F.col("span.begin") - 1)
    edge = F.when(F.col("span.begin") > 1, F.get("turns", F.col("span.begin") - 2)["end"])
    kept = F.filter(earlier, lambda t: edge - t["end"] + t["size"] <= history)
    # What the last block handed on stands before this block's turns.
    used, tail_end = F.coalesce(edge - F.get("turns", F.lit(0))["end"] + F.get("turns", F.lit(0))["size"], F.lit(0)), F.element_at("tail", -1)["end"]
    handed = F.when(F.size("tail") > 0, F.filter("tail", lambda t: tail_end - t["end"] + t["size"] + used <= history)).otherwise(F.col("tail"))
    fresh_sys = F.col("own") & (F.col("span.window") == 0)
    parts = each.select(F.col("conv.id").alias(id_col), "block", F.col("span.window").alias("window"), F.when(F.col("sys").isNull(), F.filter("turns", lambda t: F.lit(False))).otherwise(F.array("sys")).alias("sys"), fresh_sys.alias("fresh_sys"), F.concat(handed, kept).alias("old"), new.alias("new"))
    before = F.aggregate(F.concat("sys", "old"), F.lit(0), lambda n, t: n + t["chars"])
    parts = parts.withColumn("before", before)
    # A fold over the new turns: the characters so far and the spans found.
    nothing = F.array().cast("array<struct<begin:int,end:int>>")
    fold = F.aggregate("new", F.struct(F.col("before").alias("at"), nothing.alias("loss")), lambda s, t: F.struct((s["at"] + t["chars"]).alias("at"), F.when((t["role"] == learn_from) & (t["chars"] > t["head"] + len(END)), F.concat(s["loss"], F.array(F.struct((s["at"] + t["head"]).alias("begin"), (s["at"] + t["chars"] - len(END)).alias("end"))))).otherwise(s["loss"]).alias("loss")))
    every = F.concat("sys", "old", "new")
    return parts.select(
        F.col(f"`{id_col}`"),
        "block",
        "window",
        F.array_join(F.transform(every, lambda t: t["piece"]), "").alias("text"),
        (F.size("old") + F.when(F.col("fresh_sys"), 0).otherwise(F.size("sys"))).alias("n_repeated"),
        (F.size("new") + F.when(F.col("fresh_sys"), 1).otherwise(0)).alias("n_new"),
        F.aggregate(every, F.lit(0).cast("long"), lambda n, t: n + t["size"]).alias("n_tokens"),
        fold["loss"].alias("loss"),
    )


def _stretch(t: Column) -> Column:
    """The stretch of ``room`` tokens that the turn belongs to, and whether it crosses into it."""
    low = F.floor((t["end"] - t["size"] - F.col("base")) / F.col("room"))
    crosses = F.floor((t["end"] - 1 - F.col("base")) / F.col("room")) > low
    group = F.when(crosses, F.floor((t["end"] - F.col("base")) / F.col("room"))).otherwise(low)
    return F.struct(group.alias("group"), crosses.alias("crosses"), t["size"].alias("size"), t["end"].alias("end"))


def _begins(i: Column) -> Column:
    """Whether a window begins with the ``i``-th turn: another stretch, or after a crossing turn that doesn't fit with its stretch."""
    this, last = F.get("places", i - 1), F.get("places", i - 2)
    reach = F.array_max(F.transform(F.filter("places", lambda t: t["group"] == this["group"]), lambda t: t["end"]))
    return (i == 1) | (this["group"] != last["group"]) | (last["crosses"] & (reach - last["end"] + last["size"] > F.col("room")))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of a window's text."""
    pieces = F.split(text, END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    at = lambda p: F.instr(p, SAYS)
    return F.transform(pieces, lambda p: F.struct(unescaped(F.substring(p, F.lit(len(OPEN) + 1), at(p) - len(OPEN) - 1)).alias("role"), unescaped(F.substring(p, at(p) + len(SAYS), F.length(p))).alias("text")))
