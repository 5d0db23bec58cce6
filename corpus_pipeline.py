"""The corpus pipeline: language, repeated lines, near duplicates, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its decisions take effect. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.language import identify, train
from cadenza.llm.line_dedup import dedup_lines
from cadenza.llm.mixing import mixed_rows
from cadenza.llm.ngram_join import ngram_components
from cadenza.llm.sentencepieces import sentencepiece_ids
from cadenza.llm.shared import bounded, free_name, written


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a 128-bit key of the whole row, so that rows without an id or of one id are told apart; the key's name."""
    key, row = free_name(docs.columns, "row_key"), [F.col(f"`{c}`") for c in docs.columns]
    # An argument that is null leaves the hash as it was: which ones are is hashed as well.
    nulls = F.concat(*[F.when(c.isNull(), "n").otherwise("v") for c in row])
    return docs.withColumn(key, F.struct(F.xxhash64(F.lit(1), nulls, *row).alias("a"), F.xxhash64(F.lit(2), nulls, *row).alias("b"))), key


def _without(keyed: DataFrame, key: str, gone: DataFrame, name: str, keep_key: bool = False) -> DataFrame:
    """``keyed`` less the keys in ``gone``: texts stay where they are while those are few."""
    rest = keyed.join(bounded(written(gone.select(key), name)), key, "left_anti")
    return rest if keep_key else rest.drop(key)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language. Rows are judged one by one, also without an id or where one repeats."""
    model = train(docs, id_col="doc_id", text_col="text", label_col="lang")
    keyed, key = _keyed(docs)
    found = identify(keyed, model, id_col=key, declared=F.col("lang"), host=F.col("source"))
    return _without(keyed, key, found.filter("not accepted"), "language-rejected")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in one of them; documents that lose all their text this way go."""
    # Columns of the input that have the names of the operator's results get their own back.
    own = {c: free_name(docs.columns, f"own_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    kept = dedup_lines(docs.withColumnsRenamed(own))
    rest = kept.filter("n_dropped = 0 or length(trim(text)) > 0")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rest.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a similarity of 0.8 or more: that of the smallest id.

    Rows without an id come after those with one; of rows of one id, that of the least key stays, and of equal rows one.
    """
    keyed, key = _keyed(docs)
    member = free_name(keyed.columns, "member")
    ranked = keyed.withColumn(member, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(f"{key}.a").alias("a"), F.col(f"{key}.b").alias("b")))
    groups = ngram_components(ranked, id_col=member, k=5, threshold=(8, 10))
    groups = groups.select((F.col("component_id") == F.col(member)).alias("stays"), F.struct(F.col(f"{member}.a").alias("a"), F.col(f"{member}.b").alias("b")).alias(key))
    rest = _without(keyed, key, groups.filter("not stays"), "near-duplicates-gone", keep_key=True)
    again = written(groups.filter("stays").groupBy(key).count().filter("count > 1").select(key), "near-duplicates-equal")
    if again.isEmpty():
        return rest.drop(key)
    return rest.join(bounded(again), key, "left_anti").unionByName(rest.join(bounded(again), key, "left_semi").dropDuplicates([key])).drop(key)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of 150% of all words takes them, sources weighing 5, 2, 1."""
    return mixed_rows(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row and whether decoding them gives its text back."""
    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    found = sentencepiece_ids(docs.select("doc_id", "source", "text"), model=model, decoded_col="decoded")
    return found.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_text"))


STAGES = [
    ("language", known_language),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("sentencepiece", pieces),
]
#: Trained models, random rounding and pieces are beyond SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
