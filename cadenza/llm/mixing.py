"""Mixing sources to target weights by dependent (pivotal) rounding, in DataFrame expressions only.

A source's target divided by its size is the expected number of copies of each of its items: a whole part that every item gets
and a fraction. An item's fraction of its size is its mass. Two items meet, a random share of mass moves from one to the other so
that the expected masses and the sum stay as they are, and one of them becomes empty or full, hence decided. Items are folded
in buckets of about :data:`FAN`; what each bucket leaves undecided is an item of the next level, so a reduction tree of
log_FAN(items) levels ends with one undecided item per source. The words taken differ from the target by less than one item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.shared import bounded, free_name, written

#: Items that meet in one bucket, on average.
FAN = 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chance(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, items, target: ``share`` times all sizes by weight, none above ``most`` times its own size.

    Sources in code point order, null last, take the weights in turn. Those whose share per weight reaches their bound are
    found by one pass over the sources by bound per weight; that is where repeated resharing of the excess ends. The table has a
    row per source, so its windows need one task; sources are the parts of a mix, thousands at most.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("items"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    table = by.withColumn("w", F.element_at(F.lit([float(w) for w in weights]), (place % len(weights) + 1).cast("int")))
    table = table.withColumn("top", F.lit(float(most)) * F.col("source_size"))
    up = W.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    all_of = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.sum("top").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing))
    level = (F.lit(float(share)) * F.sum("source_size").over(all_of) - before) / left
    table = table.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("top") / F.col("w"), F.col("level"))
    # The first source by bound that the level fits sets it for those after it.
    table = table.withColumn("level", F.first(fits, ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return table.select("source", "source_size", "items", F.least(F.coalesce(F.col("w") * F.col("level"), F.col("top")), F.col("top")).alias("target"))


def _meet(level: int, seed: int):
    """One step of the fold: state (rest, done) and the next item."""

    def decided(item: Column, bit: int) -> Column:
        return F.array(F.struct(item["id"].alias("id"), item["size"].alias("size"), item["rows"].alias("rows"), item["whole"].alias("whole"), F.lit(bit).alias("bit")))

    def with_mass(item: Column, mass: Column) -> Column:
        return F.struct(item["h"].alias("h"), item["id"].alias("id"), item["size"].alias("size"), item["rows"].alias("rows"), item["whole"].alias("whole"), item["full"].alias("full"), mass.alias("mass"))

    def step(state: Column, item: Column) -> Column:
        def go(s: Column) -> Column:
            a, b = s["a"], s["b"]
            up, down = F.least(a["full"] - a["mass"], b["mass"]), F.least(a["mass"], b["full"] - b["mass"])
            gain = _chance(F.lit(seed + level), a["h"], b["h"]) * (up + down) < down
            case = (
                F.when(a.isNull(), 0)
                .when(gain, F.when(a["full"] - a["mass"] <= b["mass"], 1).otherwise(2))
                .otherwise(F.when(a["mass"] <= b["full"] - b["mass"], 3).otherwise(4))
            )
            return _let(F.struct(case.alias("case"), a.alias("a"), b.alias("b"), s["done"].alias("done")), ends)

        def ends(s: Column) -> Column:
            a, b, case, done = s["a"], s["b"], s["case"], s["done"]
            rest = (
                F.when(case == 0, b)
                .when(case == 1, with_mass(b, b["mass"] - (a["full"] - a["mass"])))
                .when(case == 2, with_mass(a, a["mass"] + b["mass"]))
                .when(case == 3, with_mass(b, b["mass"] + a["mass"]))
                .otherwise(with_mass(a, a["mass"] - (b["full"] - b["mass"])))
            )
            more = F.when(case == 0, F.slice(done, 1, 0)).when(case == 1, decided(a, 1)).when(case == 2, decided(b, 0)).when(case == 3, decided(a, 0)).otherwise(decided(b, 1))
            return F.struct(rest.alias("rest"), F.concat(done, more).alias("done"))

        return _let(F.struct(state["rest"].alias("a"), item.alias("b"), state["done"].alias("done")), go)

    return step


def mix_to_targets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 20260101,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, size, source, source_size, target, copies, taken (``copies * size``).

    Sizes are words; null and empty texts have size 0 and get the whole part of their copies. Rows that agree in id, source and
    size are one item: they share its decision, and each is returned. Reruns with the same ``seed`` agree. Nulls in the id or
    source are values like others, an empty table gives none, and other columns are not read.
    """
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sized")
    per_source = written(targets(sized, weights, share, most), "mix-targets")
    largest = per_source.agg(F.max("items")).first()[0] or 0
    plan = bounded(per_source.withColumnRenamed("source", "own"))

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    items = sized.groupBy("id", "source", "size").agg(F.count("*").alias("rows"))
    items = items.join(plan, F.col("source").eqNullSafe(F.col("own"))).withColumn("ratio", ratio).withColumn("whole", F.floor(F.col("ratio") + 1e-12).cast("int"))
    full = (F.col("size") * F.col("rows")).cast("double")
    item = F.struct(
        F.xxhash64(F.lit(seed), "id", "source", "size").alias("h"), "id", "size", "rows", "whole", full.alias("full"), (F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)) * full).alias("mass")
    ).alias("item")
    current = items.select("source", "items", item)

    out, level, kind = [], 0, current.schema["item"].dataType
    done_type = f"array<struct<id:{kind['id'].dataType.simpleString()},size:bigint,rows:bigint,whole:int,bit:int>>"
    while True:
        buckets = F.ceil(F.col("items") / float(FAN ** (level + 1)))
        dealt = current.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), F.col("item.h")), buckets))
        start = F.struct(F.lit(None).cast(kind).alias("rest"), F.array().cast(done_type).alias("done"))
        fold = F.aggregate(F.array_sort(F.collect_list("item")), start, _meet(level, seed))
        folded = written(dealt.groupBy("source", "bucket").agg(F.first("items").alias("items"), fold.alias("s")), "mix-level")
        out.append(folded.select("source", F.explode("s.done").alias("d")).select("source", "d.*"))
        current = folded.select("source", "items", F.col("s.rest").alias("item"))
        level += 1
        if FAN**level >= largest:
            break
    last = current.select("source", F.col("item.*")).withColumn("bit", F.when(_chance(F.lit(seed), F.col("h")) * F.col("full") < F.col("mass"), 1).otherwise(0))
    out.append(last.select("source", "id", "size", "rows", "whole", "bit"))
    decided = out[0]
    for more in out[1:]:
        decided = decided.unionByName(more)

    copies = (F.col("whole") + F.col("bit")).cast("int")
    rows = decided.join(plan, F.col("source").eqNullSafe(F.col("own"))).withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return rows.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """``docs`` itself, all its columns under their names, each row as often as the mix takes it."""
    decided = mix_to_targets(docs, id_col=id_col, source_col=source_col, text_col=text_col, **how)
    # Names that the input can't have.
    own_id, own_source, own_size, copies, words, copy = (free_name(docs.columns, f"mix_{x}") for x in ("id", "source", "size", "copies", "words", "copy"))
    chosen = decided.groupBy(F.col(id_col).alias(own_id), F.col(source_col).alias(own_source), F.col("size").alias(own_size)).agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    sized = docs.withColumn(words, word_count(F.col(f"`{text_col}`")))
    match = F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & F.col(f"`{source_col}`").eqNullSafe(F.col(own_source)) & (F.col(words) == F.col(own_size))
    joined = sized.join(bounded(written(chosen, "mix-chosen")), match).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
