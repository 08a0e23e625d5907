"""Explicit schemas for every table and result."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("chunk_index_in_file", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

# The stored chunk table: the language ratio is computed once, when a chunk is written.
STORED_CHUNK = T.StructType(CHUNK.fields + [T.StructField("english_ratio", T.DoubleType())])

EMBEDDING = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
    ]
)

WIDE = T.StructType(CHUNK.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("tf", T.IntegerType()),
        T.StructField("doc_len", T.IntegerType()),
        T.StructField("english_ratio", T.DoubleType()),
    ]
)

BUCKETED_POSTINGS = T.StructType(
    POSTINGS.fields
    + [T.StructField("chunk_bucket", T.IntegerType()), T.StructField("term_bucket", T.IntegerType())]
)

DOC_STATS = T.StructType(
    [T.StructField("chunk_id", T.StringType()), T.StructField("doc_len", T.IntegerType())]
)

DOC_FREQUENCY = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("df", T.LongType())]
)

BUCKETED_FREQUENCY = T.StructType(
    DOC_FREQUENCY.fields + [T.StructField("term_bucket", T.IntegerType())]
)

# What is stored of META: sums, to which each batch adds its own row.
META_PART = T.StructType([T.StructField("N", T.LongType()), T.StructField("length", T.LongType())])

META = T.StructType([T.StructField("N", T.LongType()), T.StructField("avgdl", T.DoubleType())])

LEXICON = T.StructType(
    [
        T.StructField("term", T.StringType(), False),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("whitelisted", T.BooleanType(), False),
    ]
)

EVAL = T.StructType(
    [
        T.StructField("question_id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("fact", T.StringType()),
        T.StructField("fact_source", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)

CHUNK_COLUMNS = CHUNK.fieldNames()
TEXT_COLUMNS = ["text", "source_file", "chunk_index_in_file"]
