"""BM25 and reciprocal-rank arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n_chunks: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1)."""
    return F.log((n_chunks - df + 0.5) / (df + 0.5) + 1.0)


def bm25_term(
    idf_value: Column,
    tf: Column,
    doc_len: Column,
    avgdl: Column,
    weight: Column,
    k1: float,
    b: float,
) -> Column:
    """One term's weighted contribution to a chunk's score."""
    saturation = tf + k1 * (1.0 - b + b * doc_len / avgdl)
    return idf_value * (tf * (k1 + 1.0)) / saturation * weight


def reciprocal_rank(rank: Column, rrf_k: int) -> Column:
    """1 / (rrf_k + rank) for a 1-based rank."""
    return F.lit(1.0) / (F.lit(rrf_k) + rank)
