"""The registered queries of the numbered operators: each reads its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.chat_windows import chat_windows, read_turns, unescaped
from cadenza.llm.fill_middle import fill_in_middle, restored
from cadenza.llm.fingerprint import edited_pairs, fingerprint, likeness, text_form
from cadenza.llm.language import declared_language, identify, train, url_host, visible_text
from cadenza.llm.line_dedup import dedup_lines
from cadenza.llm.mixing import mix_to_targets
from cadenza.llm.ngram_join import ngram_components
from cadenza.llm.prefix_trie import conversation_trie
from cadenza.llm.sentencepieces import sentencepiece_ids
from cadenza.llm.shared import fresh_path
from cadenza.llm.token_counts import count_tokens
from cadenza.llm.token_files import read_token_files, write_token_files
from cadenza.llm.vector_search import nearest
from cadenza.llm.warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document in a mix of 150% of all words, sources weighing 5, 2, 1 and at most doubled."""
    mix = mix_to_targets(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether decoding them gives the text back."""
    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = sentencepiece_ids(docs, model=model, decoded_col="decoded")
    return pieces.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_text"))


@_query
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found of every fiftieth vector."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query
def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and their likeness."""
    pairs = edited_pairs(_table(spark, sf_dir, "documents")).withColumn("edited_fp", fingerprint(F.col("edited")))
    return pairs.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        text_form(F.col("fp")).alias("fingerprint"),
        text_form(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


@_query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.9 or more."""
    return ngram_components(_table(spark, sf_dir, "documents"), k=3, threshold=(90, 100))


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as token files and read back."""
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    manifest = write_token_files(_table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), tokenizer=path, end_id=2)
    return read_token_files(manifest, ids=False)


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of documents from a fresh digest cache."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer=str(model), cache=fresh_path(spark, "token-cache"), limit=4096)


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts before and after line dedup, and the digest of what is kept."""
    kept = dedup_lines(_table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each page from its text, the language its markup declares, its address's suffix and its host's and domain's priors."""
    model = train(_table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", label_col="lang")
    pages = _table(spark, sf_dir, "pages").select("page_id", visible_text(F.col("html")).alias("text"), declared_language(F.col("html")).alias("declared"), url_host(F.col("url")).alias("host"))
    return identify(pages, model, id_col="page_id", declared=F.col("declared"), host=F.col("host"))


@_query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    return archive_round_trip(_table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at lines into prefix, middle and suffix, the digest of the new text and of the one rebuilt from it."""
    docs = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, rate=100, spm_rate=50)
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("text")).alias("output_sha256"), digest(restored(F.col("text"), F.col("form"))).alias("restored_sha256"))


@_query
def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted in windows of 1,024 tokens, and what is read back from these: all turns, and the text under the loss mask."""
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    windows = chat_windows(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd), budget=1024, history=256)
    turns = F.slice(read_turns(F.col("text")), F.col("n_repeated") + 1, F.greatest(F.col("n_new"), F.lit(1)))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: unescaped(F.substring("text", s["begin"] + 1, s["end"] - s["begin"]))), "")
    rows = windows.select("conv_id", F.size(turns).cast("long").alias("n"), F.length("text").cast("long").alias("chars"), F.struct("block", "window", said.alias("said"), learnt.alias("learnt")).alias("part"))
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))
    joined = whole.select("*", F.array_join(F.col("parts.said"), "").alias("said"), F.array_join(F.col("parts.learnt"), "").alias("learnt"))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return joined.select("conv_id", "n_turns", digest(F.col("said")).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), digest(F.col("learnt")).alias("loss_sha256"), "formatted_chars")


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with a beginning that five of them share."""
    trie = conversation_trie(_table(spark, sf_dir, "conversations"), group=5, most_shared=8)
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op8_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (SELECT *, {_KEY} AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, (c.key IS NOT NULL AND k.doc_id <> c.keeper) AS drop FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
# Base32 of the 40 hexadecimal digits of a SHA-1: each letter takes 5 bits out of two neighbouring digits.
_DIGIT = "(strpos('0123456789abcdef', substr(x, {0} + 1, 1)) - 1)"
_LETTER = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_DIGIT.format('i * 5 // 4')} * 16 + {_DIGIT.format('i * 5 // 4 + 1')}) >> (3 - i * 5 % 4)) & 31)::INT + 1, 1)"
ORACLES["op10_warc"] = f"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: {_LETTER}), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM d
"""
_DRAW = "('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), {0}, 8))::BIGINT"
ORACLES["op11_fill_in_middle"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS cut,
    {_DRAW.format(1)} AS h1, {_DRAW.format(9)} AS h2, {_DRAW.format(17)} AS h3, {_DRAW.format(25)} AS h4 FROM documents
), u AS (SELECT *, len(cut) - (cut[-1] = '')::INT AS n FROM d),
-- The text before a cut of k lines: k lines with their line ends, or the whole text.
e AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
p AS (
  SELECT *, CASE WHEN a = n THEN text WHEN a = 0 THEN '' ELSE array_to_string(cut[1:a], chr(10)) || chr(10) END AS prefix,
    CASE WHEN b = n THEN text WHEN b = 0 THEN '' ELSE array_to_string(cut[1:b], chr(10)) || chr(10) END AS until,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e
), q AS (SELECT *, substr(until, length(prefix) + 1) AS middle, substr(text, length(until) + 1) AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM q
"""
# CRC-32 bit by bit over the digits of a number.
_BIT = "xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)"
_CRC = f"list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda r, d: list_reduce(list_prepend(xor(r, d), range(8)), lambda v, i: {_BIT}))"
ORACLES["op13_prefix_trie"] = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT c, c - c % 5 AS src, xor({_CRC}, 4294967295) % 9 AS h, count(*) AS n FROM t GROUP BY c),
lent AS (SELECT n.c, n.src, n.h, least(n.h, coalesce(s.n, 0)) AS k FROM n LEFT JOIN n s ON n.src = s.c),
r AS (
  SELECT l.c, t.pos AS d, t.role, t.text FROM lent l JOIN t ON t.c = l.src AND t.pos <= l.k
  UNION ALL SELECT l.c, t.pos - l.h + l.k, t.role, t.text FROM lent l JOIN t ON t.c = l.c AND t.pos > l.h
), p AS (
  SELECT c, d, list({{'role': role, 'text': text}}) OVER (PARTITION BY c ORDER BY d) AS path, octet_length(encode(text)) AS bytes FROM r
  UNION ALL SELECT c, 0, [], 0 FROM n
), e AS (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM p),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last), '')) AS ends_sha256 FROM e GROUP BY path, d
), kids AS (
  SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), tree AS (
  SELECT x.*, coalesce(k.n_children, 0) AS n_children, u.conv_id AS parent_conv_id
  FROM nodes x LEFT JOIN kids k ON x.path = k.path LEFT JOIN nodes u ON x.d > 0 AND u.path = x.path[1:x.d - 1]
), below AS (
  -- Of each node, its ancestors and itself: the prefixes of its first member.
  SELECT a.path, sum((x.n_children = 0)::INT) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved_tokens
  FROM tree x JOIN p a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.path
)
SELECT t.conv_id, t.d AS depth, t.parent_conv_id, t.n_convs, t.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, t.ends_sha256
FROM tree t JOIN below b ON t.path = b.path
"""
_MARKED = "regexp_replace(regexp_replace({0}, '\\[(\\\\*/?INST\\])', '[\\\\\\1', 'g'), '<(\\\\*/s>)', '<\\\\\\1', 'g')"
ORACLES["op12_chat_windows"] = f"""
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), large AS (SELECT conv_id, count(*) AS n, min(turn) AS low, max(turn) AS high FROM a GROUP BY conv_id HAVING count(*) > 512),
p AS (
  SELECT a.*, CASE WHEN n IS NULL THEN 0 WHEN turn IS NULL THEN -1 ELSE floor((turn - low) * n / ((high - low + 1) * 512)) END AS part,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 3 AS size,
    length('[INST]' || {_MARKED.format('role')} || '[/INST]' || {_MARKED.format('text')} || '</s>') AS chars
  FROM a LEFT JOIN large ON a.conv_id IS NOT DISTINCT FROM large.conv_id
), o AS (
  SELECT *, row_number() OVER w AS place, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS pend, row_number() OVER c AS pos
  FROM p WINDOW w AS (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text), c AS (PARTITION BY conv_id ORDER BY part, turn NULLS FIRST, role, text)
), k AS (
  SELECT *, pend - size AS pbegin, dense_rank() OVER (PARTITION BY conv_id ORDER BY part, (place - 1) // 512) AS block,
    pos = 1 AND role = 'system' AS is_sys, max(CASE WHEN pos = 1 AND role = 'system' THEN size ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_size,
    max(CASE WHEN pos = 1 AND role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_chars FROM o
), t AS (SELECT *, min(pbegin) OVER (PARTITION BY conv_id, block) AS base, greatest(1, 1024 - 256 - sys_size) AS room FROM k WHERE NOT is_sys),
x AS (SELECT *, (pbegin - base) // room AS low, (pend - 1 - base) // room > (pbegin - base) // room AS crosses FROM t),
g AS (SELECT *, CASE WHEN crosses THEN (pend - base) // room ELSE low END AS stretch FROM x),
f AS (
  SELECT *, lag(stretch) OVER b AS last_stretch, coalesce(lag(crosses) OVER b AND max(pend) OVER (PARTITION BY conv_id, block, stretch) - lag(pbegin) OVER b > room, false) AS full_up
  FROM g WINDOW b AS (PARTITION BY conv_id, block ORDER BY pos)
), begun AS (SELECT conv_id, block, pos, base, pbegin AS edge, sys_chars FROM f WHERE last_stretch IS NULL OR last_stretch <> stretch OR full_up),
same AS (
  SELECT b.conv_id, sum(t.chars) AS chars FROM begun b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.block = b.block AND t.pos < b.pos AND b.edge - t.pbegin <= 256 GROUP BY b.conv_id
), tails AS (SELECT *, max(pend) OVER (PARTITION BY conv_id, block) AS last FROM t),
handed AS (
  SELECT b.conv_id, sum(t.chars) AS chars FROM begun b JOIN tails t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.block = b.block - 1 AND t.last - t.pbegin + b.edge - b.base <= 256 GROUP BY b.conv_id
), alone AS (SELECT k.conv_id, count(*) AS n FROM k WHERE is_sys AND NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id IS NOT DISTINCT FROM k.conv_id AND t.block = k.block) GROUP BY k.conv_id),
spent AS (SELECT conv_id, sum(sys_chars) AS chars FROM begun GROUP BY conv_id),
whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars) FILTER (NOT is_sys) AS own, max(sys_chars) AS sys_chars FROM k GROUP BY conv_id
)
SELECT w.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
  (coalesce(own, 0) + coalesce(spent.chars, 0) + coalesce(same.chars, 0) + coalesce(handed.chars, 0) + CASE WHEN alone.n > 0 THEN w.sys_chars ELSE 0 END)::BIGINT AS formatted_chars
FROM whole w LEFT JOIN spent ON w.conv_id IS NOT DISTINCT FROM spent.conv_id LEFT JOIN same ON w.conv_id IS NOT DISTINCT FROM same.conv_id
  LEFT JOIN handed ON w.conv_id IS NOT DISTINCT FROM handed.conv_id LEFT JOIN alone ON w.conv_id IS NOT DISTINCT FROM alone.conv_id
"""
