"""Line dedup: lines that many documents share are kept in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import bounded, free_name, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    """128 bits. The seeds stand first: what follows an argument is a function of its hash."""
    return F.struct(F.xxhash64(F.lit(1), key).alias("a"), F.xxhash64(F.lit(2), key).alias("b"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text_col`` rewritten and n_lines, n_dropped added.

    A line's key is the line stripped of white space and lower-cased (A-Z). Keys of at least ``min_chars`` code points found under
    at least ``min_docs`` different ids lose their lines except under the largest such id; the other lines stay in their order.
    Null texts count as one empty line. Rows that repeat an id are one document and lose the same lines; rows with a null id are
    no document: they don't count and lose every line that is over the threshold. Columns n_lines and n_dropped of the input
    are replaced, others are kept as they are.

    Keys travel as 128-bit hashes, once per document; a hot line's documents are counted by (line, document) first.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    parts = F.split(text, "\n")
    keys = F.filter(F.transform(parts, _key), lambda k: F.length(k) >= min_chars)
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.array_distinct(F.transform(keys, _hash))).alias("h"))
    common = lines.groupBy("h").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs).select("h", "keeper")
    common = written(common, "lines-common")
    # Names that the input can't have.
    owner, lost, kept = (free_name(docs.columns, x) for x in ("line_owner", "lines_lost", "lines_kept"))
    lose = lines.join(bounded(common), "h").filter(~F.col("id").eqNullSafe(F.col("keeper")))
    lose = lose.groupBy(F.col("id").alias(owner)).agg(F.collect_set("h").alias(lost))

    joined = docs.join(lose, F.col(f"`{id_col}`").eqNullSafe(F.col(owner)), "left")
    stay = F.filter(parts, lambda line: ~((F.length(_key(line)) >= min_chars) & F.array_contains(F.col(lost), _hash(_key(line)))))
    joined = joined.withColumn(kept, F.when(F.col(lost).isNotNull(), stay))
    n = F.size(parts).cast("long")
    out = {text_col: F.when(F.col(kept).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n")), "n_lines": n, "n_dropped": F.when(F.col(kept).isNull(), F.lit(0).cast("long")).otherwise(n - F.size(kept))}
    same = {k.lower() for k in out}
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in same], *[v.alias(k) for k, v in out.items()])
