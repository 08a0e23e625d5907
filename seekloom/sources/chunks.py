"""Chunk records and lake listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekloom.config import CHUNK_DIR, CHUNK_FILE, EMBEDDING_DIR
from seekloom.functions.text import english_ratio
from seekloom.schemas import CHUNK
from seekloom.sources.shards import read_embedding_shards


def with_slash(base: str) -> str:
    """The base path with exactly one trailing slash added if it has none."""
    return base if base.endswith("/") else base + "/"


def read_chunks(spark: SparkSession, glob: str) -> DataFrame:
    """JSON-lines chunk records; the schema is fixed, so files are read once."""
    return spark.read.schema(CHUNK).json(glob)


def stored_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk rows with the language ratio that keyword search filters on."""
    return chunks.select(*CHUNK.fieldNames(), english_ratio("text").alias("english_ratio"))


def load_batch(spark: SparkSession, base: str, model_name: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and embeddings of one batch directory laid out like the lake."""
    base = with_slash(base)
    return (
        read_chunks(spark, f"{base}{CHUNK_DIR}/*/{CHUNK_FILE}"),
        read_embedding_shards(spark, f"{base}{EMBEDDING_DIR}/", model_name),
    )


def list_lake(spark: SparkSession, base: str) -> DataFrame:
    """``(directory, files, bytes)`` below a base path; file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(base)
        .select("path", "length")
    )
    return files.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("directory")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
