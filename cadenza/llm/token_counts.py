"""Token counts with a digest cache: each distinct text is encoded once per tokenizer, ever."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.shared import small_batches, written

_CACHE = "digest binary, tokenizer string, n_tokens long"
_loaded: dict[str, Callable[[list[str]], list]] = {}


def load_tokenizer(path: str) -> Callable[[list[str]], list]:
    """``texts -> ids of each``: sentencepiece for .model, tokenizers for .json; no added tokens. Kept for the worker's life."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: pieces.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            bpe = Tokenizer.from_file(path)
            bpe.no_padding()
            bpe.no_truncation()
            _loaded[path] = lambda texts: [e.ids for e in bpe.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def version_of(path: str) -> str:
    """The tokenizer's version digest: of its kind and its file."""
    with open(path, "rb") as f:
        return os.path.splitext(path)[1] + ":" + hashlib.file_digest(f, "sha256").hexdigest()


def text_groups(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, so that the ids held at once stay few."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def _once(batches):
    """Rows of (digest, text) whose digest this task hasn't had: copies go no further. Holds 32 bytes a row of the task."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for d in batch.column(0).to_pylist():
            fresh.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(fresh))


def _counted(path: str):
    def run(batches):
        encode, last = load_tokenizer(path), None
        for batch in batches:
            digests, fresh = batch.column(0).to_pylist(), []
            for d in digests:
                fresh.append(d != last)
                last = d
            own = batch.filter(pa.array(fresh))
            counts = [len(ids) for group in text_groups(own.column(1).to_pylist()) for ids in encode(group)]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def _cached(spark: SparkSession, path: str, version: str) -> DataFrame:
    try:
        cache = spark.read.schema(_CACHE).parquet(path)
    except AnalysisException:  # no such table yet
        cache = spark.createDataFrame([], _CACHE)
    return cache.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, *, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit (``n_tokens > limit``).

    ``cache`` is the folder of the cache table (made if missing), ``tokenizer`` a file that all executors have. Content is the whole
    text, null as empty; it is not changed otherwise, since counts depend on every character. Distinct contents whose digest the cache
    lacks for this tokenizer's version are encoded and appended in one committed write; then all rows join the cache. Copies are
    dropped in the task that reads them and once more where their digests meet.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = version_of(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))
    contents = docs.select(digest.alias("digest"), text.alias("text")).mapInArrow(_once, "digest binary, text string")
    known = _cached(spark, cache, version).select("digest")
    misses = contents if known.isEmpty() else contents.join(known, "digest", "left_anti")
    counted = misses.repartition("digest").sortWithinPartitions("digest").mapInArrow(_counted(tokenizer), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    rows = docs.select(F.col(id_col), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    # Written first: aggregated in the stage of the join, they would keep Spark from splitting the rows of a hot digest.
    found = rows.join(written(_cached(spark, cache, version), "token-counts"), "digest")
    return found.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
