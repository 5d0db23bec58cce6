"""Token ids in binary files: written in ascending id order, read back with their places in the whole.

A file holds documents that follow each other: a header (number of documents, block count, their ids' presence and values, their id
counts), then the blocks of :mod:`cadenza.llm.context_coder`. Blocks are reset and checksummed one by one.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.context_coder import BLOCK, cut, decode_all, encode_all
from cadenza.llm.shared import small_batches, written
from cadenza.llm.shingles import slices, text_buffers
from cadenza.llm.token_counts import load_tokenizer, text_groups

MAGIC = b"TOKMIX02"
#: Blocks coded side by side, and files whose blocks are.
TOGETHER, FILES = 512, 4
#: Distinct words that a task keeps with their ids; beyond, it starts anew.
KNOWN = 600_000


#: Of bytes: ASCII letters 1, printable ASCII signs that are neither letters nor digits 2.
_KINDS = np.array([1 if chr(i).isalpha() else 2 if 0x20 < i < 0x7F and not chr(i).isdigit() else 0 for i in range(128)] + [0] * 128, np.uint8)


class FileFormatError(ValueError):
    """A file that is not one of this format, or is cut off."""


def pack_files(files: list[tuple[list[int | None], np.ndarray | list[int], np.ndarray]]) -> list[bytes]:
    """Whole files of (document ids, id counts, all ids); their blocks are coded side by side."""
    # a step codes one id of every block, so few ids take shorter blocks: many steps of few blocks are slow
    block = min(BLOCK, max(1 << 12, sum(len(ids) for _, _, ids in files) // 128))
    parts = [cut(ids, block) for _, _, ids in files]
    flat, blocks = [x for own in parts for x in own], []
    for at in range(0, len(flat), TOGETHER):
        blocks += encode_all(flat[at : at + TOGETHER])
    found = []
    for (doc_ids, counts, _), own in zip(files, parts, strict=True):
        present = np.array([i is not None for i in doc_ids], np.uint8)
        values = np.array([i or 0 for i in doc_ids], "<i8")
        head = present.tobytes() + values.tobytes() + np.array(counts, "<u4").tobytes()
        body = b"".join(struct.pack("<III", n, crc, len(code)) + code for n, crc, code in blocks[: len(own)])
        del blocks[: len(own)]
        found.append(MAGIC + struct.pack("<III", len(doc_ids), len(own), zlib.crc32(head)) + head + body)
    return found


def pack_file(doc_ids: list[int | None], counts: np.ndarray | list[int], ids: np.ndarray) -> bytes:
    """A whole file."""
    return pack_files([(doc_ids, counts, ids)])[0]


def _parts(raw: bytes) -> tuple[list[int | None], np.ndarray, list[tuple[int, int, bytes]]]:
    """(document ids, id counts, blocks) of a file."""
    if raw[:8] != MAGIC or len(raw) < 20:
        raise FileFormatError("not a token file")
    n, n_blocks, crc = struct.unpack_from("<III", raw, 8)
    at = 20 + n * 13
    if zlib.crc32(raw[20:at]) != crc or len(raw) < at:
        raise FileFormatError("the header fails its checksum")
    present = np.frombuffer(raw, np.uint8, n, 20)
    values = np.frombuffer(raw, "<i8", n, 20 + n)
    counts = np.frombuffer(raw, "<u4", n, 20 + 9 * n)
    blocks = []
    for _ in range(n_blocks):
        if at + 12 > len(raw):
            raise FileFormatError("the file is cut off")
        size, block_crc, length = struct.unpack_from("<III", raw, at)
        blocks.append((size, block_crc, raw[at + 12 : at + 12 + length]))
        at += 12 + length
    if at != len(raw):
        raise FileFormatError("the file is cut off")
    return [int(v) if p else None for p, v in zip(present, values, strict=True)], counts, blocks


def unpack_files(raws: list[bytes]) -> list[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, id counts, all ids) of each file; their blocks are decoded side by side."""
    heads = [_parts(raw) for raw in raws]
    blocks, ids = [b for _, _, own in heads for b in own], []
    for at in range(0, len(blocks), TOGETHER):
        ids += decode_all(blocks[at : at + TOGETHER])
    found = []
    for doc_ids, counts, own in heads:
        found.append((doc_ids, counts, np.concatenate([np.zeros(0, np.uint32), *ids[: len(own)]])))
        del ids[: len(own)]
    return found


def unpack_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, id counts, all ids) of a file."""
    return unpack_files([raw])[0]


def _byte_level(path: str) -> list[str] | None:
    """The added tokens of a byte-level tokenizer whose words can be encoded one by one; None for other tokenizers."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    words = spec.get("pre_tokenizer") or {}
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
    return [t["content"] for t in spec.get("added_tokens", [])] if plain and not spec.get("normalizer") else None


def _word_starts(raw: np.ndarray) -> np.ndarray:
    """ASCII white space after a character that is surely none, and ASCII signs after an ASCII letter: there the byte-level pattern
    always begins a new word.

    That pattern looks ahead only at white space and never back, so what stands before such a place doesn't matter behind it.
    """
    solid = (raw > 0x20) & (raw < 0x7F)
    # Of two-byte characters, white space is only among those that begin with C2.
    solid[1:] |= (raw[1:] >= 0x80) & (raw[:-1] >= 0xC3) & (raw[:-1] < 0xE0)
    opens = np.zeros(len(raw), bool)
    opens[1:] = ((raw[1:] == 0x20) | ((raw[1:] >= 0x09) & (raw[1:] <= 0x0D))) & solid[:-1]
    kind = _KINDS.take(raw)
    opens[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
    return opens


class Encoder:
    """Ids of columns of texts, as the tokenizer's library gives them; a byte-level tokenizer encodes each distinct word once."""

    def __init__(self, path: str) -> None:
        self.encode, self.added = load_tokenizer(path), _byte_level(path)
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct words stand among those known; new ones are encoded."""
        if len(self.words) > KNOWN:
            self._forget()
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if (new := np.flatnonzero(at < 0)).size:
            at[new] = len(self.words) + np.arange(len(new))
            fresh, ids, sizes = words.take(pa.array(new)), [self.ids], []
            for a in range(0, len(new), 10_000):
                found = self.encode(fresh.slice(a, 10_000).to_pylist())
                sizes += map(len, found)
                ids.append(np.fromiter(chain.from_iterable(found), np.int32))
            self.words, self.ids = pa.concat_arrays([self.words, fresh]), np.concatenate(ids)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return at

    def _by_words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        opens = _word_starts(raw)
        opens[0] = True
        opens[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(opens)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        places = self._places(words.dictionary).take(words.indices.to_numpy(zero_copy_only=False))
        lists = pa.LargeListArray.from_arrays(self.ends, self.ids).take(pa.array(places))
        ids, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        bounds = ends[np.searchsorted(starts, offsets)]
        return ids[bounds[0] : bounds[-1]], bounds - bounds[0]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last end)."""
        raw, offsets = text_buffers(texts)
        if self.added is not None and not any(pc.any(pc.match_substring(texts, t)).as_py() for t in self.added):
            return self._by_words(raw, offsets)
        found = [np.array(ids, np.int32) for group in text_groups(texts.fill_null("").to_pylist()) for ids in self.encode(group)]
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.cumsum([0, *map(len, found)])


def _writer(folder: str, tokenizer: str, end_id: int, ids_per_file: int):
    def write(batches):
        encoder = Encoder(tokenizer)
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        part, place = TaskContext.get().partitionId(), 0
        doc_ids, counts, ids, held, ready = [], [], [], 0, []

        def close():
            nonlocal doc_ids, counts, ids, held
            ready.append((doc_ids, np.concatenate(counts), np.concatenate(ids)))
            doc_ids, counts, ids, held = [], [], [], 0

        def flush():
            nonlocal place
            rows = []
            for (own, _, some), raw in zip(ready, pack_files(ready), strict=True):
                name = f"{uuid.uuid4().hex}.tok"
                with store.open_output_stream(f"{top}/{name}", compression=None) as out:
                    out.write(raw)
                rows.append((part, place, name, len(own), len(some)))
                place += 1
            ready.clear()
            kinds = [("part", pa.int32()), ("place", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, 4 << 20):
                found, bounds = encoder.column(batch.column(1).slice(a, b - a))
                doc_ids += batch.column(0).slice(a, b - a).to_pylist()
                counts.append(np.diff(bounds) + 1)
                ids.append(np.insert(found, bounds[1:], end_id))
                held += len(ids[-1])
                if held >= ids_per_file:
                    close()
                    if len(ready) == FILES:
                        yield flush()
        if doc_ids:
            close()
        if ready:
            yield flush()

    return write


def write_token_files(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", ids_per_file: int = 4 << 20) -> DataFrame:
    """Encodes whole texts (null: empty), each closed by ``end_id``, to files in ``folder``; manifest: part, place, path, documents, ids.

    Files follow ascending ids (null ids first; rows that repeat an id stand by the hashes of their texts, so a hot id is dealt over
    several tasks). A file is closed when it has ``ids_per_file`` ids. A task holds ``FILES`` of them, whose blocks are coded side by
    side, and the ids of one slice of texts. A file is written whole under a name of its own before the manifest names it, so repeated
    attempts do no harm.
    """
    spark = docs.sparkSession
    small_batches(spark, 4)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("tie"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (2 * FILES * ids_per_file)), min(spark.sparkContext.defaultParallelism, size >> 20))
    dealt = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    manifest = dealt.mapInArrow(_writer(folder, tokenizer, end_id, ids_per_file), "part int, place int, file string, documents long, ids long")
    return written(manifest.select("part", "place", F.concat(F.lit(folder.rstrip("/") + "/"), "file").alias("path"), "documents", "ids"), "token-manifest")


def _read(batches):
    for batch in batches:
        uris, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k in range(0, len(uris), FILES):
            raws = []
            for uri in uris[k : k + FILES]:
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as stream:
                    raws.append(stream.read())
            for start, (doc_ids, counts, ids) in zip(starts[k : k + FILES], unpack_files(raws), strict=True):
                ends = np.cumsum(counts, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                step = 500
                for a in range(0, len(doc_ids), step):
                    b = min(a + step, len(doc_ids))
                    own = [raw[4 * (int(ends[i]) - int(counts[i])) : 4 * int(ends[i])] for i in range(a, b)]
                    columns = [pa.array(doc_ids[a:b], pa.int64()), pa.array(start + ends[a:b] - counts[a:b], pa.int64()), pa.array(counts[a:b].astype(np.int64)), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def _read_without_ids(batches):
    for batch in _read(batches):
        yield batch.select(["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, *, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32[, ids: little-endian unsigned 32-bit] of every document.

    Starts are running sums over the manifest, a row per file: within groups of 1,024 parts, after those over the groups.
    """
    group = F.floor(F.col("part") / 1024).alias("group")
    groups = manifest.groupBy(group).agg(F.sum("ids").alias("all")).select("group", F.coalesce(F.sum("all").over(W.orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("ids").over(W.partitionBy("group").orderBy("part", "place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.withColumn("group", group).withColumn("own", own).join(groups, "group").select("path", (F.col("base") + F.col("own")).alias("start"))
    files = written(starts, "token-starts")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    count = files.count()
    tasks = max(1, -(-count // FILES), min(count, manifest.sparkSession.sparkContext.defaultParallelism))
    return files.repartitionByRange(tasks, "start").mapInArrow(_read if ids else _read_without_ids, schema + ", ids binary" * ids)
