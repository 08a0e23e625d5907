"""Embedding shards: a directory with a matrix file and an id list, paired by name.

A shard is read in row ranges: one task reads the matrix's header and walks the id list, and
gives a row per range with its ids; other tasks then read the bytes of their ranges. So no
file is ever held in a row, and a shard may have any size. Stores that only Spark can open are
read file by file instead (:func:`decode_shards`), which bounds a file to 2 GB.
"""

from __future__ import annotations

import codecs
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekloom.config import IDS_FILE, VECTOR_FILE
from seekloom.plans.sizing import in_tasks
from seekloom.schemas import EMBEDDING

EMIT_ROWS = 8_192  # rows per Arrow batch, so a large shard leaves the decoder in pieces
RANGE_BYTES = 64 * 1024 * 1024  # of a matrix that one task reads
READ_BYTES = 1024 * 1024  # of an id list read at a time


def shard_name(path: str, model_name: str, file_name: str):
    """The shard directory of a path under the model's segment, or "" if it does not match."""
    pattern = f"/{re.escape(model_name)}/([^/]+)/{re.escape(file_name)}$"
    return F.regexp_extract(path, pattern, 1)


def pair_shards(vector_files: DataFrame, id_files: DataFrame, model_name: str) -> DataFrame:
    """Join ``(path, content)`` rows of both kinds on the shard name.

    Paths outside the layout have no shard name and are left out rather than paired
    with each other.
    """

    def named(files: DataFrame, file_name: str, content: str) -> DataFrame:
        return files.select(
            shard_name("path", model_name, file_name).alias("shard"),
            F.col("content").alias(content),
        ).filter(F.col("shard") != "")

    return named(vector_files, VECTOR_FILE, "vector_bytes").join(
        named(id_files, IDS_FILE, "id_bytes"), "shard", "inner"
    )


def decode_shards(pairs: DataFrame, on_mismatch: str = "fail") -> DataFrame:
    """``(chunk_id, embedding)`` rows of paired shards.

    A shard with a different number of ids and vectors is an error, or with
    ``on_mismatch="truncate"`` is cut to the shorter side.
    """
    if on_mismatch not in ("fail", "truncate"):
        raise ValueError(f"unknown on_mismatch: {on_mismatch}")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, vector_bytes, id_bytes in zip(
                batch.column("shard").to_pylist(),
                batch.column("vector_bytes"),
                batch.column("id_bytes"),
                strict=True,
            ):
                ids = [str(value) for value in json.loads(id_bytes.as_py())]
                vectors = np.load(
                    io.BytesIO(vector_bytes.as_buffer()), allow_pickle=False
                ).astype(np.float32, copy=False)
                if len(ids) != len(vectors) and on_mismatch == "fail":
                    raise ValueError(f"shard {shard}: {len(ids)} ids, {len(vectors)} vectors")
                rows = min(len(ids), len(vectors))
                for start in range(0, rows, EMIT_ROWS):
                    part = slice(start, min(start + EMIT_ROWS, rows))
                    block = np.ascontiguousarray(vectors[part])
                    offsets = np.arange(len(block) + 1, dtype=np.int32) * block.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[part], pa.string()),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.ravel())),
                        ],
                        names=["chunk_id", "embedding"],
                    )

    return pairs.mapInArrow(decode, EMBEDDING)


def _opened(path: str):
    """A file for random reads, in a store that Arrow knows."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return fs.LocalFileSystem().open_input_file("/" + (rest or path).lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(inner)


@dataclass(frozen=True)
class MatrixLayout:
    """Where the values of a stored matrix are."""

    rows: int
    width: int
    dtype: np.dtype
    by_column: bool
    offset: int

    def read(self, file, start: int, stop: int) -> np.ndarray:
        """Rows ``start`` to ``stop`` as float32, reading their bytes alone."""
        size = self.dtype.itemsize
        if not self.by_column:
            data = file.read_at((stop - start) * self.width * size, self.offset + start * self.width * size)
            return np.frombuffer(data, self.dtype).reshape(-1, self.width).astype(np.float32)
        columns = [
            np.frombuffer(
                file.read_at((stop - start) * size, self.offset + (at * self.rows + start) * size), self.dtype
            )
            for at in range(self.width)
        ]
        return np.stack(columns, axis=1).astype(np.float32)


def matrix_layout(file) -> MatrixLayout:
    """The layout of an open matrix file, from its header."""
    version = np.lib.format.read_magic(file)
    header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = header(file)
    if len(shape) != 2 or dtype.hasobject:
        raise ValueError(f"a shard holds a matrix of numbers, not {dtype} of shape {shape}")
    return MatrixLayout(*shape, dtype, by_column, file.tell())


def listed_ids(file) -> Iterator[str]:
    """The entries of a JSON list as text, read piece by piece."""
    decoder, text, at, done = json.JSONDecoder(), "", 0, False
    decode = codecs.getincrementaldecoder("utf-8")()
    opened = False
    while True:
        piece = file.read(READ_BYTES)
        done = not piece
        text, at = text[at:] + decode.decode(piece, done), 0
        while True:
            while at < len(text) and (text[at].isspace() or (text[at] == "," and opened)):
                at += 1
            if at >= len(text):
                break
            if not opened:
                if text[at] != "[":
                    raise ValueError("an id file holds one JSON list")
                opened, at = True, at + 1
                continue
            if text[at] == "]":
                return
            try:
                value, end = decoder.raw_decode(text, at)
            except json.JSONDecodeError:
                if done:
                    raise
                break
            # An entry ends before a comma or the bracket; what ends elsewhere may go on.
            after = end
            while after < len(text) and text[after].isspace():
                after += 1
            if text[after : after + 1] not in (",", "]"):
                break
            yield str(value)
            at = after
        if done:
            raise ValueError("an id file ends before its list does")


def _ranges(folder: str, on_mismatch: str) -> Iterator[tuple[int, list[str]]]:
    """``(first row, ids)`` of the row ranges of a shard."""
    with _opened(f"{folder}/{VECTOR_FILE}") as file:
        layout = matrix_layout(file)
    rows = max(1, RANGE_BYTES // max(1, layout.width * layout.dtype.itemsize))
    seen, held = 0, []
    with _opened(f"{folder}/{IDS_FILE}") as file:
        for value in listed_ids(file):
            if seen < layout.rows:
                held.append(value)
            seen += 1
            if len(held) == rows:
                yield seen - rows, held
                held = []
    if seen != layout.rows and on_mismatch == "fail":
        raise ValueError(f"shard {folder}: {seen} ids, {layout.rows} vectors")
    if held:
        yield min(seen, layout.rows) - len(held), held


def shard_vectors(spark: SparkSession, folders: DataFrame, on_mismatch: str = "fail") -> DataFrame:
    """``(chunk_id, embedding)`` rows of the shards in ``folders(folder)``, read in row ranges.

    A shard with a different number of ids and vectors is an error, or with
    ``on_mismatch="truncate"`` is cut to the shorter side.
    """
    if on_mismatch not in ("fail", "truncate"):
        raise ValueError(f"unknown on_mismatch: {on_mismatch}")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for start, ids in _ranges(folder, on_mismatch):
                    yield pa.RecordBatch.from_pydict(
                        {"folder": [folder], "start": [start], "ids": pa.array([ids], pa.list_(pa.string()))}
                    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                folder, start = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                ids = batch.column(2)[row].values
                with _opened(f"{folder}/{VECTOR_FILE}") as file:
                    layout = matrix_layout(file)
                    for low in range(0, len(ids), EMIT_ROWS):
                        high = min(low + EMIT_ROWS, len(ids))
                        block = layout.read(file, start + low, start + high)
                        offsets = np.arange(len(block) + 1, dtype=np.int32) * layout.width
                        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.ravel()))
                        yield pa.RecordBatch.from_arrays(
                            [ids.slice(low, high - low), lists], names=["chunk_id", "embedding"]
                        )

    ranges = in_tasks(folders.select("folder")).mapInArrow(plan, "folder string, start long, ids array<string>")
    # The ranges of one large shard go to different tasks.
    return in_tasks(ranges).mapInArrow(read, EMBEDDING)


def read_embedding_shards(
    spark: SparkSession, base: str, model_name: str, on_mismatch: str = "fail"
) -> DataFrame:
    """Read all shards under ``{base}/{model_name}/*/`` that have both files."""
    if on_mismatch not in ("fail", "truncate"):
        raise ValueError(f"unknown on_mismatch: {on_mismatch}")
    base = base if base.endswith("/") else base + "/"

    def files(name: str, *columns: str) -> DataFrame:
        return spark.read.format("binaryFile").load(f"{base}{model_name}/*/{name}").select("path", *columns)

    if not re.match(r"(file|s3a?|gs|hdfs):|[^:]*$", base):
        found = files(VECTOR_FILE, "content"), files(IDS_FILE, "content")
        return decode_shards(pair_shards(*found, model_name), on_mismatch)
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    # Only the listings are joined; no file is opened for them.
    both = files(VECTOR_FILE).select(folder).join(files(IDS_FILE).select(folder), "folder")
    return shard_vectors(spark, both, on_mismatch)
