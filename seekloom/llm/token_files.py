"""Token ids of whole texts in Parquet list columns, laid out for selective reads."""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END_ID = 0
ROW_GROUP_BYTES = 16 * 1024 * 1024
PAGE_ROWS = 256
PIECE_CACHE = 800_000  # pieces a worker remembers; the half that was not asked for lately goes first
LONGEST_PIECE = 24  # characters of a piece beyond which it is not remembered
SLICE_CHARS = 1_000_000  # text encoded at a time
SLICE_ROWS = 256  # texts that a worker holds as strings at once
MARKS = ",.!;:?"
# A single space between two other characters, whatever a library takes for white space.
SPACE_CUT = re.compile("(?<=[^\\s\u180e]) (?=[^\\s\u180e])")

_SCHEMA = "doc_id long, part int, place long, n_tokens long, tokens array<int>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("part", pa.int32()),
        ("place", pa.int64()),
        ("n_tokens", pa.int64()),
        ("tokens", pa.list_(pa.int32())),
    ]
)


def _byte_alphabet() -> dict[int, int]:
    """The visible character that a byte-level vocabulary has for each byte, by its rule."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [byte for byte in range(256) if byte not in visible]
    return {byte: 256 + at for at, byte in enumerate(rest)}


_PACKERS = [struct.Struct(f"<{count}I").pack for count in range(16)]


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return _PACKERS[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(dict):
    """Ids of pieces after ``lead``, encoded when they are first asked for; long ones are not kept.

    What is asked for again is taken over from ``older``, the pieces of the time before.
    """

    def __init__(self, tokenizer, lead: str, older: dict[str, bytes]) -> None:
        super().__init__()
        self._older = older
        self._tokenizer, self._model, self._lead = tokenizer, tokenizer.model, lead
        self._alphabet = _byte_alphabet()
        self._shown = lead.translate(self._alphabet)
        self._marks: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return _packed(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def alone(self) -> _Pieces:
        """The same pieces without the older ones."""
        self._older = {}
        return self

    def __missing__(self, piece: str) -> bytes:
        found = self._older.pop(piece, None)
        if found is not None:
            self[piece] = found
            return found
        if piece.isalpha():
            shown = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self._alphabet)
            ids = [token.id for token in self._model.tokenize(self._shown + shown)]
            found = _packed(ids)
        elif piece[-1:] in MARKS and piece[-2:-1].isalpha():
            mark = piece[-1]
            if mark not in self._marks:
                self._marks[mark] = self._encode(mark)
            found = self[piece[:-1]] + self._marks[mark]
        else:
            found = self._encode(self._lead + piece)
        if len(piece) <= LONGEST_PIECE:
            self[piece] = found
        return found


class PieceEncoder:
    """Encode whole texts with a byte-level BPE tokenizer, remembering pieces.

    The tokenizer's first step cuts a text before a single space that stands between two
    other characters, and around a single line feed that does, whatever surrounds them.
    So the pieces between such cuts can be encoded apart with the same ids; words around any
    other white space are one piece. A piece that ends in a letter and one
    mark is cut before the mark for the same reason. A piece of letters alone goes straight
    to the tokenizer's model, as the earlier steps change nothing but its alphabet.
    Frequent pieces are encoded once; long ones are not kept, so that what a worker remembers
    is bounded in bytes.
    """

    def __init__(self, path: str, pieces: int | None = None) -> None:
        from tokenizers import Tokenizer

        self._tokenizer, self._most = Tokenizer.from_file(path), pieces or PIECE_CACHE
        self._head, self._tail = (_Pieces(self._tokenizer, lead, {}) for lead in ("", " "))

    def _forget(self) -> None:
        self._head, self._tail = (
            _Pieces(self._tokenizer, lead, held.alone()) for lead, held in (("", self._head), (" ", self._tail))
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self._head) + len(self._tail) > self._most // 2:
            self._forget()
        head, tail = self._head.__getitem__, self._tail.__getitem__
        found = []
        for text in texts:
            ids: list[bytes] = []
            glued = ""
            parts = text.split("\n")
            for at, line in enumerate(parts):
                line = glued + line
                after = parts[at + 1] if at + 1 < len(parts) else None
                cut = after and not after[0].isspace() and line and not line[-1].isspace()
                if after is not None and not cut:
                    glued = line + "\n"
                    continue
                glued = ""
                if line:
                    pieces = line.split(" ")
                    # Printable characters have no other white space than the space.
                    single = "" not in pieces if line.isprintable() else line.split() == pieces
                    if not single:
                        pieces = SPACE_CUT.split(line)
                    ids.append(head(pieces[0]))
                    ids.extend(map(tail, pieces[1:]))
                if after is not None:
                    ids.append(head("\n"))
            found.append(b"".join(ids))
        return found


@functools.lru_cache(maxsize=1)
def _encoder(path: str, pieces: int | None = None) -> PieceEncoder:
    return PieceEncoder(path, pieces)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for at, text in enumerate(texts):
        held += len(text)
        if held >= SLICE_CHARS:
            yield begin, at + 1
            begin, held = at + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, pieces: int | None = None
) -> DataFrame:
    """``(doc_id, part, place, n_tokens, tokens)`` in ascending doc_id order.

    ``place`` counts the ids of earlier documents of the same partition ``part``.
    Null text is encoded as an empty text; each document ends with ``end_id``. A worker
    remembers the ids of ``pieces`` pieces (PIECE_CACHE if none is given), about 200 bytes each.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker that ran other stages gives back what Arrow keeps for it.
        pa.default_memory_pool().release_unused()
        encoder, place = _encoder(tokenizer_path, pieces), 0
        part = TaskContext.get().partitionId()
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS)):
            ids, texts = batch.column(0), [text or "" for text in batch.column(1).to_pylist()]
            for begin, stop in _slices(texts):
                found = [one + end for one in encoder.encode(texts[begin:stop])]
                lengths = np.asarray([len(one) // 4 for one in found], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                values = np.frombuffer(b"".join(found), dtype="<i4")
                tokens = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(values, pa.int32())
                )
                yield pa.record_batch(
                    [
                        ids.slice(begin, stop - begin),
                        pa.array(np.full(stop - begin, part), pa.int32()),
                        pa.array(place + offsets[:-1], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        tokens,
                    ],
                    schema=_ARROW,
                )
                place += int(offsets[-1])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    return (
        ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie.asc())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie.asc())
        .mapInArrow(encode, _SCHEMA)
    )


def write_tokens(encoded: DataFrame, path: str) -> None:
    """Write encoded documents: a dictionary for the ids, delta encoding for the counters.

    Row groups are bounded in bytes and pages in rows. Parquet's page index then lets a
    reader of some documents skip pages, and one of the counters skip the ids.
    """
    writer = encoded.write.option("compression", "zstd").option("parquet.writer.version", "v2")
    writer = writer.option("parquet.block.size", ROW_GROUP_BYTES)
    writer = writer.option("parquet.page.row.count.limit", PAGE_ROWS)
    writer = writer.option("parquet.enable.dictionary", "true")
    for counter in ("doc_id", "place", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{counter}", "false")
    writer.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, part, place, start, n_tokens)`` from the counters alone.

    ``start`` is the number of ids of all documents before. The window runs over one row
    per partition that was written.
    """
    counters = spark.read.schema(_SCHEMA).parquet(path).drop("tokens")
    held = counters.groupBy(F.col("part").alias("_part")).agg(F.sum("n_tokens").alias("_held"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("_part", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_base"))
    return counters.join(before, counters["part"] == before["_part"]).select(
        "doc_id", "part", "place", (F.col("_base") + F.col("place")).alias("start"), "n_tokens"
    )


def read_tokens(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """``(doc_id, part, place, tokens)`` of the documents from ``first`` to ``last``."""
    tokens = spark.read.schema(_SCHEMA).parquet(path).select("doc_id", "part", "place", "tokens")
    if first is not None:
        tokens = tokens.filter(F.col("doc_id") >= first)
    return tokens if last is None else tokens.filter(F.col("doc_id") <= last)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            tokens = batch.column(3)
            values = tokens.values.to_numpy(zero_copy_only=False).astype("<u4")
            offsets = tokens.offsets.to_numpy()
            sums = [crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            counts = pa.array(np.diff(offsets), pa.int64())
            arrays = [*batch.columns[:3], counts, pa.array(sums, pa.int64())]
            yield pa.record_batch(arrays, names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    found = read_tokens(spark, path).mapInArrow(
        digest, "doc_id long, part int, place long, n_tokens long, ids_crc32 long"
    )
    bases = (
        read_index(spark, path)
        .groupBy(F.col("part").alias("_part"))
        .agg(F.min(F.col("start") - F.col("place")).alias("_base"))
    )
    return found.join(bases, found["part"] == bases["_part"]).select(
        "doc_id", (F.col("_base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
