"""Audit queries: which ids reached which table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekloom.functions.text import basename


def _tagged(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per (chunk_id, table) as count columns, from one shuffle on the id.

    Rows are counted before they are exchanged, so an id repeated many times costs one
    row per task.
    """
    names = list(frames)
    tagged = reduce(
        DataFrame.unionByName,
        [f.select("chunk_id", F.lit(name).alias("table")) for name, f in frames.items()],
    ).filter(F.col("chunk_id").isNotNull())
    return tagged.groupBy("chunk_id").agg(
        *[F.count_if(F.col("table") == name).alias(name) for name in names]
    )


def coverage(source: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: ``total`` source rows and, per table, rows of the join on ``chunk_id``."""
    counts = _tagged({"_source": source, **tables})
    zero = F.lit(0).cast("long")
    return counts.agg(
        F.coalesce(F.sum("_source"), zero).alias("known"),
        *[
            F.coalesce(F.sum(F.col("_source") * F.col(name)), zero).alias(name)
            for name in tables
        ],
    ).select(
        source.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total"), *list(tables)
    )


def coverage_sql(source: DataFrame, text: DataFrame, emb: DataFrame, wide: DataFrame) -> DataFrame:
    """The same audit over three tables as one SQL statement with scalar subqueries."""
    return source.sparkSession.sql(
        """
        SELECT (SELECT count(*) FROM {source}) AS total,
               (SELECT count(*) FROM {source} JOIN {text} USING (chunk_id)) AS in_text,
               (SELECT count(*) FROM {source} JOIN {emb} USING (chunk_id)) AS in_emb,
               (SELECT count(*) FROM {source} JOIN {wide} USING (chunk_id)) AS in_wide
        """,
        source=source,
        text=text,
        emb=emb,
        wide=wide,
    )


def match_audit(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: distinct ids among chunks, among embeddings, and in both."""
    counts = _tagged({"c": chunks, "e": embeddings})
    return counts.agg(
        F.count_if(F.col("c") > 0).alias("chunks"),
        F.count_if(F.col("e") > 0).alias("embeddings"),
        F.count_if((F.col("c") > 0) & (F.col("e") > 0)).alias("matched"),
    )


def source_files(chunks: DataFrame) -> DataFrame:
    """Distinct file names, without their directories."""
    return chunks.select(basename("source_file").alias("source_file")).distinct()
