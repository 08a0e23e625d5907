"""Parameters, passed explicitly; nothing is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass

# Names and patterns of the on-disk chunk/vector layout.
CHUNK_DIR = "optimized_chunks"
EMBEDDING_DIR = "optimized_embeddings"
CHUNK_FILE = "chunks.jsonl"
VECTOR_FILE = "embeddings.npy"
IDS_FILE = "chunk_ids.json"


@dataclass(frozen=True)
class KeywordConfig:
    """BM25 retrieval parameters."""

    k1: float = 1.2
    b: float = 0.75
    k: int = 50
    df_ratio_max: float = 0.03
    top_terms: int = 5
    min_terms: int = 2
    english_ratio_min: float | None = 0.35
    oversample: int = 5
    filter_first: bool = True


@dataclass(frozen=True)
class FusionConfig:
    """Reciprocal-rank fusion parameters of the stand-alone hybrid search."""

    top_each: int = 10
    top_n: int = 10
    rrf_k: int = 60


@dataclass(frozen=True)
class AnswerConfig:
    """Parameters of the question-to-prompt run."""

    fusion: FusionConfig = FusionConfig(top_each=100, top_n=20, rrf_k=20)
    keyword: KeywordConfig = KeywordConfig()
    rerank_top_k: int = 10
    candidate_limit: int | None = 50


@dataclass(frozen=True)
class LakeConfig:
    """Where the tables live and how finely they are bucketed.

    ``chunk_buckets`` bounds what an upsert rewrites, ``term_buckets`` bounds what a
    keyword query scans. Size them so that one bucket of one generation is a few GB.
    """

    root: str
    chunk_buckets: int = 64
    term_buckets: int = 16
    lower_first: bool = True
    index_scope: str = "chunks"


@dataclass(frozen=True)
class Budget:
    """Upper bounds for what may be broadcast; anything larger takes a shuffle path."""

    max_rows: int = 2_000_000
    max_bytes: int = 128 * 1024 * 1024


DEFAULT_BUDGET = Budget()
