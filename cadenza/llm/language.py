"""Language identification by Bayesian evidence fusion.

The likelihood of a text is that of its byte trigrams under each language's model, plus a model of no language (all trigrams alike).
It is combined with what the markup declares, with the address suffix, and with priors of hosts: the counts of text languages by
host are smoothed with those by domain, and these with those of all texts (grouped aggregation; rows join them by key).
"""

from __future__ import annotations

import math
from html.entities import name2codepoint

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import bounded, small_batches, written
from cadenza.llm.shingles import _LOWER, _SEP, slices, text_buffers

UNKNOWN = "und"
BUCKETS = 4096
#: Address suffixes and the language they speak for.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}


#: A start tag, end tag or declaration; quoted values may hold a ">". Repeated groups are possessive, so that long tags need no stack.
_TAG = r"""<[a-zA-Z/!?](?:[^"'>]|"[^"]*+"|'[^']*+')*+>|<[a-zA-Z/!?][^>]*+>"""
#: What no reader sees: comments, scripts and styles, up to the end where they aren't closed.
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_ATTRIBUTE = r"""([^\s"'=<>/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def url_host(url: Column) -> Column:
    """The host of an address in lower case, without user, port and trailing dot; null if there is none."""
    found = F.regexp_extract(url, r"(?i)^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:@\s]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"\.+$", ""), F.lit(""))


def declared_language(html: Column) -> Column:
    """The language that the ``lang`` attribute (else ``xml:lang``) of the html tag names, without region; null if there is none."""
    tag = F.regexp_extract(F.regexp_replace(html, _UNSEEN, " "), r"""(?i)<html(?=[\s/>])((?:[^"'>]|"[^"]*+"|'[^']*+')*+)>""", 1)
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2))
    each = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda a: a["name"].isin("lang", "xml:lang"))
    first = F.array_min(F.transform(each, lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value"))))["value"]
    return F.nullif(F.lower(F.regexp_extract(first, r"""^["']?\s*([A-Za-z]+)""", 1)), F.lit(""))


def _character(reference: Column) -> Column:
    """What "name;", "#123;" or "#x1F;" at the start of ``reference`` stands for, with the rest; other text with its "&"."""
    name = F.regexp_extract(reference, r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-zA-Z][a-zA-Z0-9]*);", 1)
    rest = F.substr(reference, F.length(name) + 2)
    known = F.map_from_arrays(F.lit([*name2codepoint, "apos"]), F.lit([*map(chr, name2codepoint.values()), "'"]))
    number = F.when(F.lower(name).startswith("#x"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).try_cast("long")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    coded = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(name == "", F.concat(F.lit("&"), reference)).when(name.startswith("#"), F.concat(F.when(valid, coded).otherwise(" "), rest)).otherwise(F.coalesce(F.concat(F.try_element_at(known, name), rest), F.concat(F.lit("&"), reference)))


def visible_text(html: Column) -> Column:
    """The text of a page: without comments, scripts, styles and tags, character references resolved."""
    parts = F.split(F.regexp_replace(F.regexp_replace(html, _UNSEEN, " "), _TAG, " "), "&")
    return F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), _character)), "")


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket at each byte that starts one, its row, rows that have anything but white space)."""
    n = len(offsets) - 1
    low = _LOWER[raw].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    filled = np.zeros(n, bool)
    filled[row[~_SEP[raw]]] = True
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), filled
    code = ((low[:-2] | (low[1:-1] << 8) | (low[2:] << 16)) * np.uint32(2654435761)) >> np.uint32(20)
    inside = row[:-2] == row[2:]
    return code[inside].astype(np.int64), row[:-2][inside], filled


def _count_rows(languages: list[str]):
    def run(batches):
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for a, b in slices(offsets):
                code, row, _ = _grams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts += np.bincount(lang[a:b][row] * BUCKETS + code, minlength=counts.size).reshape(counts.shape)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(counts[at])], ["lang", "gram", "n"])

    return run


def train(docs: DataFrame, *, id_col: str, text_col: str, label_col: str, rows_per_label: int = 1000) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, trigram]) from about ``rows_per_label`` rows of each label, all rows of smaller ones.

    Rows are sampled by a hash of id and text, so reruns agree; the row of the least hash is always taken. Every label is learnt but
    those whose rows have no trigram of text. What reaches the driver is a count per language and trigram bucket.
    """
    rows = docs.select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)).alias("h"))
    rows = rows.filter((F.octet_length("text") >= 3) & F.col("text").rlike(r"[^ \t-\r]") & F.col("lang").isNotNull())
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).orderBy("lang").collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return [], np.zeros((0, BUCKETS))
    upto = [(r["lang"], max(r["least"] + 1, int(min(1.0, rows_per_label / r["n"]) * (1 << 30)))) for r in found]
    sample = rows.join(F.broadcast(docs.sparkSession.createDataFrame(upto, "lang string, upto long")), "lang").filter("h < upto").select("lang", "text")
    counts = np.full((len(languages), BUCKETS), 0.5)
    for r in sample.mapInArrow(_count_rows(languages), "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"], r["gram"]] += r["n"]
    return languages, np.log(counts / counts.sum(1, keepdims=True))


def _score_rows(tables: np.ndarray):
    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(batch.num_columns - 1))
            n = len(offsets) - 1
            sums, grams = np.zeros((n, len(tables))), np.zeros(n, np.int64)
            for a, b in slices(offsets):
                code, row, filled = _grams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                grams[a:b] = np.bincount(row, minlength=b - a) * filled
                for i, table in enumerate(tables):
                    sums[a:b, i] = np.bincount(row, table[code], minlength=b - a) * filled
            found = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(tables)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(grams), found], [*batch.schema.names[:-1], "grams", "ll"])

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    shifted = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def identify(
    docs: DataFrame,
    model: tuple[list[str], np.ndarray],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    trust_declared: float = 0.8,
    trust_suffix: float = 0.7,
    strength: float = 50.0,
    longest: float = 60.0,
    unknown_prior: float = 0.01,
    least: float = 0.5,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row: ``id_col``, language, confidence, text_language, accepted.

    ``declared`` is the language that the markup names, ``host`` the address's host; both may be null or unknown and then say
    nothing. ``strength`` is the number of pseudo-texts by which each level of priors is smoothed with the one above; a text counts as
    ``longest`` trigrams at most, since its trigrams depend on each other. Accepted are rows with some text whose language is known
    (and in ``keep``, if given) with a confidence of ``least`` or more. Texts without any but white space say nothing and are
    rejected. Rows that repeat an id stay rows of their own; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    languages, tables = model
    classes = [*languages, UNKNOWN]
    tables = np.concatenate([tables, np.full((1, BUCKETS), -math.log(BUCKETS))])
    none = F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), (declared if declared is not None else none).alias("declared"), (host if host is not None else none).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = written(rows.mapInArrow(_score_rows(tables), f"id {kind}, declared string, host string, grams long, ll array<double>"), "language-scores")

    names, n = F.lit(classes), len(classes)
    by_text = F.transform(F.col("ll"), lambda x: x * F.least(F.lit(1.0), F.lit(longest) / F.greatest(F.col("grams"), F.lit(1))))
    first = F.when(F.col("grams") > 0, F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")))
    domain = F.coalesce(F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")), F.col("host"))
    scored = scored.withColumn("text_language", first).withColumn("domain", domain)

    counted = scored.filter("text_language is not null").groupBy("host", "domain", "text_language").count()
    overall = {r["text_language"]: r["c"] for r in counted.groupBy("text_language").agg(F.sum("count").alias("c")).collect()}  # a row per language
    total = sum(overall.values())
    base = [(overall.get(c, 0) + 1) / (total + n) * (1 - unknown_prior) if c != UNKNOWN else unknown_prior for c in classes]

    def counts(key: str) -> DataFrame:
        return counted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum(F.when(F.col("text_language") == c, F.col("count")).otherwise(0)) for c in classes]).alias("counts"))

    def smoothed(prior: Column) -> Column:
        seen = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
        return F.zip_with("counts", prior, lambda c, p: (c + strength * p) / (seen + strength))

    domains = counts("domain").select("domain", smoothed(F.lit(base)).alias("by_domain"))
    hosts = counts("host").withColumn("domain", domain).join(domains, "domain").select("host", smoothed(F.col("by_domain")).alias("by_host"))
    hosts = written(hosts, "language-hosts")

    def says(value: Column, trust: float) -> Column:
        other = math.log((1 - trust) / max(1, len(languages) - 1))
        known = value.isin(languages) if languages else F.lit(False)
        each = F.transform(names, lambda c: F.when(c == value, math.log(trust)).when(c == UNKNOWN, -math.log(max(1, len(languages)))).otherwise(other))
        return F.when(F.coalesce(known, F.lit(False)), each).otherwise(F.array_repeat(F.lit(0.0), n))

    suffix = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[F.regexp_extract(F.coalesce("host", F.lit("")), r"\.([a-z]+)$", 1)]
    joined = scored.join(bounded(hosts), "host", "left")
    prior = F.transform(F.coalesce("by_host", F.lit(base)), lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    logs = by_text
    for more in (prior, says(F.lower("declared"), trust_declared), says(suffix, trust_suffix)):
        logs = F.zip_with(logs, more, lambda a, b: a + b)
    out = joined.withColumn("p", _softmax(logs)).withColumn("confidence", F.array_max("p"))
    out = out.withColumn("language", F.element_at(names, F.array_position("p", F.col("confidence")).cast("int")))
    accepted = (F.col("grams") > 0) & (F.col("language") != UNKNOWN) & (F.col("confidence") >= least)
    accepted = accepted & F.col("language").isin(keep) if keep is not None else accepted
    return out.select(F.col("id").alias(id_col), "language", "confidence", "text_language", accepted.alias("accepted"))
