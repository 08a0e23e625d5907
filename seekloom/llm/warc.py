"""WARC archives as tables of payload chunks, written and read in bounded memory."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
FILE_BYTES = 1 << 30
REVISIT_BYTES = 1000
BATCH_BYTES = 4 << 20
_CRLF = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = (
    "page_id long, record_id string, record_type string, refers_to long, uri string, "
    "declared_digest string, chunk_no long, chunk_start long, chunk binary, is_last boolean, "
    "digest_so_far string"
)
_CHUNK_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("uri", pa.string()),
        ("declared_digest", pa.string()),
        ("chunk_no", pa.int64()),
        ("chunk_start", pa.int64()),
        ("chunk", pa.binary()),
        ("is_last", pa.bool_()),
        ("digest_so_far", pa.string()),
    ]
)


def classify_payloads(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages with ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Of pages with equal payloads of at least ``least`` bytes the largest page_id is the
    response and the others revisit it. Rows that share that largest id (repeated rows)
    are responses each; null ids are the smallest. The largest id is a partial aggregate
    on digest and length, and the pages are joined back by it as narrow rows.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha1("payload")
    )
    groups = own.filter(F.col("payload_bytes") >= least).groupBy(
        F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")
    )
    # Only payloads that occur again can be revisited: few rows, whatever the table's size.
    first = groups.agg(F.max("page_id").alias("_latest"), F.count(F.lit(1)).alias("_times"))
    first = first.filter(F.col("_times") > 1).drop("_times")
    same = (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    revisits = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_latest"))
    return own.join(first, same, "left").select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("_latest")).alias("refers_to"),
    )


def _record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def _one_line(value: str) -> bytes:
    return value.replace("\r", "%0D").replace("\n", "%0A").encode()


def _header(pairs: list[tuple[str, str]]) -> bytes:
    lines = [b"WARC/1.1", *(name.encode() + b": " + _one_line(value) for name, value in pairs)]
    return _CRLF.join(lines) + _CRLF + _CRLF


class ArchiveWriter:
    """Write records to gzip members of one file, chunk by chunk."""

    def __init__(self, stream: BinaryIO, compress: bool = True) -> None:
        self._stream, self._compress = stream, compress
        self.written = 0

    def record(self, header: bytes, chunks: Iterator[bytes]) -> None:
        """Write one record; ``chunks`` is its block, whose length the header states."""
        pack = zlib.compressobj(1, zlib.DEFLATED, 31) if self._compress else None
        self._put(pack, header)
        for piece in chunks:
            self._put(pack, piece)
        self._put(pack, _CRLF + _CRLF)
        if pack is not None:
            self._write(pack.flush())

    def _put(self, pack, piece: bytes) -> None:
        self._write(piece if pack is None else pack.compress(piece))

    def _write(self, piece: bytes) -> None:
        self._stream.write(piece)
        self.written += len(piece)


def _pieces(payload: memoryview, size: int) -> Iterator[bytes]:
    for at in range(0, len(payload), size):
        yield payload[at : at + size]


def write_archives(
    records: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write classified records to WARC files; returns ``(path, records)`` of the files.

    A task writes files of its own, named by its attempt, and rolls them by size. Only the
    files of attempts whose rows Spark accepted are in the result, so a repeated or
    speculative attempt leaves no record twice. Paths are opened by URI with pyarrow.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        paths, counts, stream, archive = [], [], None, None
        try:
            for batch in batches:
                for at in range(batch.num_rows):
                    if archive is None or archive.written >= file_bytes:
                        if stream is not None:
                            stream.close()
                        name = f"part-{attempt}-{len(paths):04d}.warc.gz"
                        stream = store.open_output_stream(f"{root}/{name}", compression=None)
                        archive = ArchiveWriter(stream)
                        paths.append(f"{folder}/{name}")
                        counts.append(0)
                    row = {name: batch.column(name)[at] for name in batch.schema.names}
                    _write_page(archive, row, chunk_bytes)
                    counts[-1] += 1
        finally:
            if stream is not None:
                stream.close()
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    columns = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    return records.select(*columns).mapInArrow(write, "path string, records long")


def _write_page(archive: ArchiveWriter, row: dict, chunk_bytes: int) -> None:
    page_id, refers_to = row["page_id"].as_py(), row["refers_to"].as_py()
    url, kind = row["url"].as_py(), row["record_type"].as_py()
    digest = row["payload_digest"].as_py()
    payload = memoryview(row["payload"].as_buffer())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    http += f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = len(http) + (len(payload) if kind == "response" else 0)
    pairs = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{_record_id(page_id, digest)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(block)),
    ]
    pairs += [("X-Page-ID", str(page_id))] if page_id is not None else []
    pairs += [("WARC-Target-URI", url)] if url is not None else []
    if kind == "revisit":
        pairs.append(("WARC-Profile", _PROFILE))
        pairs.append(("WARC-Refers-To", f"<{_record_id(refers_to, digest)}>"))
        pairs.append(("X-Refers-To-Page-ID", str(refers_to)))
    body = _pieces(payload, chunk_bytes) if kind == "response" else iter(())

    def blocks() -> Iterator[bytes]:
        yield http
        yield from body

    archive.record(_header(pairs), blocks())


class ByteSource:
    """Bytes of a plain or gzip archive, decompressed as they are asked for."""

    def __init__(self, stream: BinaryIO, size: int = 1 << 18) -> None:
        self._stream, self._size, self._held, self._at = stream, size, b"", 0
        head = stream.read(size)
        self._raw = head
        self._unpack = zlib.decompressobj(31) if head[:2] == b"\x1f\x8b" else None

    def _more(self) -> bytes:
        while True:
            raw = self._raw or self._stream.read(self._size)
            self._raw = b""
            if self._unpack is None:
                return raw
            # The bound keeps one highly compressed read from filling memory.
            out = self._unpack.decompress(raw, self._size * 4)
            if self._unpack.eof:
                self._raw = self._unpack.unused_data
                self._unpack = zlib.decompressobj(31)
            else:
                self._raw = self._unpack.unconsumed_tail
            if out or not raw:
                return out

    def _fill(self) -> bool:
        more = self._more()
        if more:
            self._held, self._at = self._held[self._at :] + more, 0
        return bool(more)

    def line(self) -> bytes | None:
        """The next line with its end, or None at the end."""
        while True:
            end = self._held.find(b"\n", self._at)
            if end >= 0:
                line, self._at = self._held[self._at : end + 1], end + 1
                return line
            if not self._fill():
                line, self._held, self._at = self._held[self._at :], b"", 0
                return line or None

    def take(self, size: int) -> bytes:
        """At most ``size`` bytes; fewer only at the end of what is at hand."""
        if self._at >= len(self._held) and not self._fill():
            return b""
        piece = self._held[self._at : self._at + size]
        self._at += len(piece)
        return piece


def _headers(source: ByteSource) -> dict[str, str]:
    found: dict[str, str] = {}
    while line := (source.line() or b"").rstrip(_CRLF):
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def archive_chunks(stream: BinaryIO, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Rows of the chunk table for one archive, in order.

    A record without payload has one empty chunk. ``digest_so_far`` is the SHA-1 of the
    payload up to the end of its chunk; on the last chunk it is the payload's own.
    """
    source = ByteSource(stream)
    while (line := source.line()) is not None:
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        head = _headers(source)
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            while left > 0:
                line = source.line()
                if line is None:
                    raise ValueError("archive ends within a record")
                left -= len(line)
                if not line.strip():
                    break
        digest, number, start = hashlib.sha1(), 0, 0
        row = {
            "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
            "record_id": head.get("warc-record-id", "").strip("<>"),
            "record_type": head.get("warc-type"),
            "refers_to": int(x) if (x := head.get("x-refers-to-page-id", "None")) != "None" else None,
            "uri": head.get("warc-target-uri"),
            "declared_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        }
        while True:
            pieces, held = [], 0
            while held < min(chunk_bytes, left):
                piece = source.take(min(chunk_bytes, left) - held)
                if not piece:
                    raise ValueError("archive ends within a record")
                digest.update(piece)
                pieces.append(piece)
                held += len(piece)
            left -= held
            yield row | {
                "chunk_no": number,
                "chunk_start": start,
                "chunk": b"".join(pieces),
                "is_last": left == 0,
                "digest_so_far": digest.copy().hexdigest(),
            }
            number, start = number + 1, start + held
            if left == 0:
                break


def read_archives(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives in ``files`` (column ``path``).

    Each file is read as a stream by one task and leaves it as chunk rows, so a task holds
    a few chunks and never a whole record.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as stream:
                    rows, held = [], 0
                    for row in archive_chunks(stream, chunk_bytes):
                        rows.append(row)
                        held += len(row["chunk"]) + 400
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=_CHUNK_ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_CHUNK_ARROW)

    return files.select("path").mapInArrow(read, CHUNK_SCHEMA)


def record_summaries(chunks: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per record.

    The last chunk of a record carries its length and digest, so no records are grouped.
    A revisit has no payload of its own: both values come from the response that it
    names, found by its digest; a revisit without its response is an error of the archive
    and gives null length.
    """
    last = chunks.filter("is_last").select(
        "page_id",
        "record_type",
        "refers_to",
        "declared_digest",
        (F.col("chunk_start") + F.octet_length("chunk")).alias("own_bytes"),
        F.col("digest_so_far").alias("own_digest"),
    )
    revisited = last.filter("record_type = 'response'").groupBy(
        F.col("page_id").alias("_page_id"), F.col("own_digest").alias("_digest")
    ).agg(F.max("own_bytes").alias("_bytes"))
    own = last.filter("record_type = 'response'").select(
        "page_id",
        F.col("own_bytes").alias("payload_bytes"),
        F.col("own_digest").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    again = last.filter("record_type = 'revisit'")
    named = again["refers_to"].eqNullSafe(revisited["_page_id"]) & (
        again["declared_digest"] == revisited["_digest"]
    )
    # Spark can't see how much a few archive paths grow to; without the hint it would broadcast.
    resolved = again.join(revisited.hint("merge"), named, "left").select(
        "page_id",
        F.col("_bytes").alias("payload_bytes"),
        F.col("_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
    return own.unionByName(resolved)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` to archives under ``folder`` and return the files' table."""
    manifest = f"{folder}/manifest"
    write_archives(classify_payloads(pages), f"{folder}/archives").write.parquet(manifest)
    files = spark.read.schema("path string, records long").parquet(manifest)
    return files.repartition(max(1, files.count()))
