"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs, in DataFrame expressions only.

Each paragraph hashes to a wide vector; a fingerprint is the sum of its paragraphs' vectors, lane by lane modulo 2**20, so it does
not depend on their order, and paragraphs are inserted and deleted by adding and subtracting (:func:`combined`,
:func:`without`). Paragraphs are lines, cut again at sentence ends so that a small edit leaves most of a long line as it was.

Words of 64 bits hold three lanes of 20 bits with a spare bit above each, which takes the carry and is cleared. The first
:data:`EXACT` words have lanes of full range (equality); the others count, for each of 189 hash bits, the paragraphs in which
it is set. With the number of paragraphs in the last word, ``2 * count - n`` is a sum of random signs, and the cosine of
two such vectors estimates that of the paragraph multisets, with an error of about 0.07.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.shared import chunk_of, id_bounds

PARAGRAPH = r"\n|(?<=[.!?])[\x20\x09-\x0D]+"
LANE, STEP = 20, 21
EXACT, SIGNS = 6, 3
_FULL = sum(((1 << LANE) - 1) << (i * STEP) for i in range(3))
_ONES = sum(1 << (i * STEP) for i in range(3))
_SPARE = sum(1 << (i * STEP + LANE) for i in range(3))


def fingerprint(text: Column, paragraph: str = PARAGRAPH) -> Column:
    """array<long>: the fingerprint of a text (null: the empty text, one empty paragraph)."""
    parts = F.split(F.coalesce(text, F.lit("")), paragraph)

    def summed(hashes: Column, shift: int, mask: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(_FULL)))

    def words(hashed: Column) -> Column:
        exact = [summed(hashed[f"h{i}"], 0, _FULL) for i in range(EXACT)]
        signs = [summed(hashed[f"h{EXACT + i}"], k, _ONES) for i in range(SIGNS) for k in range(STEP)]
        return F.array(*exact, *signs, F.size(hashed["h0"]).cast("long").bitwiseAND(F.lit(_FULL)))

    def seeded(seed: int):
        return lambda p: F.xxhash64(F.lit(seed), p)  # the seed first: what follows an argument is a function of its hash

    def hashed(ps: Column) -> Column:
        return F.struct(*[F.transform(ps, seeded(i)).alias(f"h{i}") for i in range(EXACT + SIGNS)])

    # Each step is evaluated once, as the only element of an array.
    return F.element_at(F.transform(F.transform(F.array(parts), hashed), words), 1)


def combined(a: Column, b: Column) -> Column:
    """Fingerprint of the union of two paragraph multisets: insertion."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_FULL)))


def without(a: Column, b: Column) -> Column:
    """Fingerprint of ``a``'s multiset less ``b``'s: deletion."""
    return F.zip_with(a, b, lambda x, y: (x.bitwiseOR(F.lit(_SPARE)) - y).bitwiseAND(F.lit(_FULL)))


def _signed(fp: Column) -> Column:
    n = F.element_at(fp, -1)
    lanes = F.slice(fp, EXACT + 1, SIGNS * STEP)
    return F.flatten(F.transform(lanes, lambda w: F.array(*[2 * F.shiftrightunsigned(w, i * STEP).bitwiseAND(F.lit((1 << LANE) - 1)) - n for i in range(3)])))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints from 0 to 1: 1 if equal, else the estimated cosine of the paragraph multisets."""

    def cosine(s: Column) -> Column:
        norm = F.sqrt(_dot(s["a"], s["a"]) * _dot(s["b"], s["b"]))
        return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(s["a"], s["b"]) / norm))).otherwise(0.0)

    estimate = F.element_at(F.transform(F.array(F.struct(_signed(a).alias("a"), _signed(b).alias("b"))), cosine), 1)
    return F.when(a == b, 1.0).otherwise(estimate)


def text_form(fp: Column) -> Column:
    """The fingerprint as hexadecimal text of fixed width."""
    return F.array_join(F.transform(fp, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_chunk: int = 2000) -> DataFrame:
    """id, n_chars, text, fp, edited, next_fp: each text, its edit and the fingerprint of the next text by descending id.

    The edit replaces the last floor(n_chars / 2) code points by as many first ones of the next document (all, if fewer); after
    the last document comes the first. Null texts are empty; rows that repeat an id stand in the order of their texts' hashes; null ids
    come last. Texts are dealt once, by chunks of ids cut at quantiles (an id with the rows of several chunks is dealt over them by those
    hashes); each chunk's first document goes to the chunk before it as well, so no task sees more than a chunk.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("tie"))
    cuts = id_bounds(rows, "id", rows_per_chunk)
    place = chunk_of(F.col("id"), F.col("tie"), cuts)
    # The first of a chunk, a row each: the largest id and of its rows the least tie; null ids are alone in theirs.
    heads = rows.select("id", "tie", place.alias("chunk")).groupBy("chunk").agg(F.max(F.struct("id", (-F.col("tie")).alias("tie"))).alias("head")).orderBy(F.desc("chunk")).collect()
    spark, kind = docs.sparkSession, rows.schema["id"].dataType.simpleString()
    lend = [(b["head"]["id"], -b["head"]["tie"], a["chunk"]) for a, b in zip([heads[-1], *heads[:-1]], heads, strict=True)] if heads else []
    lend = F.broadcast(spark.createDataFrame(lend, f"head {kind}, head_tie long, lender int"))
    known = rows.withColumn("fp", fingerprint(F.col("text"))).withColumn("chunk", place)
    known = known.join(lend, F.col("id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")), "left")
    own = F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("lent"))
    places = F.when(F.col("lender").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("lender").alias("chunk"), F.lit(True).alias("lent"))))
    dealt = known.withColumn("at", F.explode(places)).select("id", "tie", "text", "fp", "at.*")
    down = W.partitionBy("chunk").orderBy("lent", F.desc("id"), "tie")
    dealt = dealt.withColumn("next", F.lead("text").over(down)).withColumn("next_fp", F.lead("fp").over(down)).filter("not lent")
    n = F.length("text").cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    return dealt.select("id", n.alias("n_chars"), "text", "fp", edited.alias("edited"), "next_fp")
