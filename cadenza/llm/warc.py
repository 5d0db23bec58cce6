"""WARC archives of web pages: written by the tasks that hold the pages, read back sequentially.

Each record is one gzip member. Writers give every file a name of its own and report it only when it is complete, so a repeated or
abandoned attempt leaves files that no manifest names. The reader inflates a file piece by piece, frames blocks by
Content-Length and verifies block and payload digests; it holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import bounded, fresh_path, small_batches, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16


class WarcError(ValueError):
    """A record that breaks the format or fails its digest."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(text: str) -> str:
    """A header value without control characters: they are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, level: int) -> bytes:
    """One gzip member: a response with its payload, or a revisit (the same HTTP header without it)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Members:
    """Reads across the gzip members of a stream."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.raw, self.plain, self.inflate = stream, b"", bytearray(), None

    def _more(self) -> bool:
        """Inflates another piece of the current member; False at its end."""
        if self.inflate.eof:
            return False
        self.raw = self.raw or self.stream.read(PIECE)
        if not self.raw:
            raise WarcError("the archive ends within a record")
        self.plain += self.inflate.decompress(self.raw)
        self.raw = self.inflate.unused_data
        return True

    def open(self) -> bool:
        """Starts the next member; False at the end of the archive."""
        if self.plain:
            raise WarcError("a record ends before its gzip member")
        self.raw = self.raw or self.stream.read(PIECE)
        self.inflate = zlib.decompressobj(31)
        return bool(self.raw)

    def until(self, mark: bytes) -> bytes:
        while (at := self.plain.find(mark)) < 0:
            if not self._more():
                raise WarcError("a header without its end")
        return self.take(at + len(mark))[: -len(mark)]

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._more():
                raise WarcError("a block shorter than its Content-Length")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def close(self) -> None:
        while self._more():
            pass


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _verify(said: str | None, data: bytes, what: str) -> None:
    if said is not None and said != f"sha1:{sha1_base32(data)}":
        raise WarcError(f"{what} digest differs")


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of each record, verified; the payload of a revisit is empty."""
    members = _Members(stream)
    while members.open():
        head = members.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise WarcError("not a WARC record")
        fields = _fields(head)
        block = members.take(int(fields["content-length"]))
        if members.take(4) != b"\r\n\r\n":
            raise WarcError("a record without its end")
        members.close()
        _verify(fields.get("warc-block-digest"), block, "block")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["warc-type"] == "response":
            _verify(fields.get("warc-payload-digest"), payload, "payload")
        yield fields, _fields(http), payload


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z", level: int = 3, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record per row to files in ``folder`` (a URI that pyarrow opens) and returns the manifest: path, records.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest id is the response (several rows of that
    id all are) and the others revisit it; smaller ones, and rows with a null id, are responses. Null html is an empty payload, a
    null url has no target. Only payload digests are shuffled, combined before; pages stay where they were read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), _payload(F.col(html_col)).alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.concat_ws(":", F.sha1("payload"), F.octet_length("payload"))))
    repeated = rows.filter("key is not null and id is not null").groupBy("key").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("key", "last")
    repeated = written(repeated, "warc-repeated")
    refers = F.when(F.col("id") < F.col("last"), F.col("last"))
    marked = rows.join(bounded(repeated), "key", "left").select("id", "url", "payload", refers.alias("refers"))

    def write(batches):
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        out, name, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for i, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                packed = record(i, url, payload, refers_to, date, level)
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= file_bytes:
                    out.close()
                    done.append((name.rsplit("/", 1)[1], n))
                    out = None
        if out is not None:
            out.close()
            done.append((name.rsplit("/", 1)[1], n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["file", "records"])

    return written(marked.mapInArrow(write, "file string, records long").select(F.concat(F.lit(folder.rstrip("/") + "/"), "file").alias("path"), "records"), "warc-manifest")


def read_archives(manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """Every record of the manifest's files: page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]."""

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for fields, http, payload in read_records(stream):
                        page = fields["warc-record-id"].removeprefix("<urn:page:").rstrip(">")
                        to = fields.get("warc-refers-to")
                        row = [int(page) if page else None, fields.get("warc-target-uri"), fields["warc-type"], int(to.removeprefix("<urn:page:").rstrip(">")) if to else None, int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")]
                        rows.append(row + [payload] * payloads)
                        held += 200 + len(payload) * payloads
                        if held > 8 << 20:
                            yield _rows(rows, payloads)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows, payloads)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(read, schema)


def _rows(rows: list, payloads: bool) -> pa.RecordBatch:
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_round_trip(pages: DataFrame, **how) -> DataFrame:
    """Writes archives to a fresh folder of the shared one and returns what reading them gives."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc"), **how))
