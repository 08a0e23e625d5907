from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from seekloom.llm import warc

PAGES = "page_id long, url string, html string, record_type string, payload string"


def summaries(spark, rows, folder):
    pages = spark.createDataFrame([(*row, "clash", "clash") for row in rows], PAGES)
    return warc.record_summaries(warc.read_archives(warc.archive_pages(spark, pages, str(folder)), 700))


def test_round_trip_with_revisits(spark, tmp_path):
    large, tricky = "é" * 900, "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n" * 40
    rows = [(1, "http://a/", large), (9, None, large), (4, "u\nv", large), (5, "u", None)]
    rows += [(6, "u", "small"), (7, "u", "small"), (8, "u", tricky), (None, "u", large), (3, "u", "x" * 5000)]
    found = {row["page_id"]: row for row in summaries(spark, rows, tmp_path / "a").collect()}
    assert len(found) == len(rows)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        row = found[page_id]
        assert row["payload_bytes"] == len(payload)
        assert row["payload_digest"] == hashlib.sha1(payload).hexdigest()
        again = html == large and page_id != 9
        assert (row["record_type"], row["refers_to"]) == (
            ("revisit", 9) if again else ("response", None)
        )


def test_repeated_rows_and_empty_table(spark, tmp_path):
    rows = [(2, "u", "y" * 1000)] * 3 + [(1, "u", "y" * 1000)]
    found = summaries(spark, rows, tmp_path / "r").collect()
    assert sorted((row["page_id"], row["record_type"]) for row in found) == [
        (1, "revisit"), (2, "response"), (2, "response"), (2, "response")
    ]
    assert summaries(spark, [], tmp_path / "e").count() == 0


def record(payload, kind="resource"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda parts: b"".join(parts), lambda parts: b"".join(map(gzip.compress, parts))])
def test_chunks_carry_incremental_digests(pack):
    payloads = [b"", b"0123456789" * 100, b"\r\n\r\nWARC/1.0", b"z" * 3_000_000]
    data = pack([record(payload) for payload in payloads])
    rows = list(warc.archive_chunks(io.BytesIO(data), 64_000))
    assert max(len(row["chunk"]) for row in rows) <= 64_000
    found, held = [], b""
    for row in rows:
        assert row["chunk_start"] == len(held)
        held += row["chunk"]
        assert row["digest_so_far"] == hashlib.sha1(held).hexdigest()
        if row["is_last"]:
            found, held = [*found, held], b""
    assert found == payloads


def test_truncated_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.archive_chunks(io.BytesIO(record(b"a" * 100)[:60])))
