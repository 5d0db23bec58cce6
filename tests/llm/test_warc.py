import base64
import gzip
import hashlib
import io

import pytest

from cadenza.llm.warc import WarcError, archive_round_trip, read_archives, read_records, record, write_archives
from cadenza.llm.shared import fresh_path


def brute(rows, least=0):
    last = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            last[data] = max(i, last.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = last.get(data)
        to = to if to is not None and i is not None and i < to else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nEvil: 1", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 200_000), (9, "u", "<p>x</p>"), (9, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (6, "u", "a\r\n\r\nb")]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumnRenamed("zzz", "key").repartition(3)
    for least in (0, 5):
        got = archive_round_trip(pages, min_bytes=least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=str) == brute(PAGES, least)
    folder = fresh_path(spark, "warc-test")
    manifest = write_archives(pages, folder, file_bytes=100)
    assert manifest.count() > 3
    texts = {r.page_id: bytes(r.payload).decode() for r in read_archives(manifest, payloads=True).collect() if r.record_type == "response"}
    assert texts[5] == "é" * 200_000 and texts[6] == "a\r\n\r\nb"
    assert archive_round_trip(pages.filter("false")).count() == 0


def test_one_member_per_record_and_damage():
    whole = record(1, "u", b"hello", None, "2026-01-01T00:00:00Z", 6) + record(2, "u", b"hello", 1, "2026-01-01T00:00:00Z", 6)
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == 2
    assert [f["warc-type"] for f, _, _ in read_records(io.BytesIO(whole))] == ["response", "revisit"]
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(whole[:-9])))
    bad = gzip.compress(gzip.decompress(whole[: len(record(1, "u", b"hello", None, "2026-01-01T00:00:00Z", 6))]).replace(b"\r\n\r\nhello", b"\r\n\r\nhullo"))
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(bad)))
