"""Reciprocal-rank fusion and hybrid search."""

from __future__ import annotations

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekloom.config import FusionConfig, KeywordConfig
from seekloom.functions.scoring import reciprocal_rank
from seekloom.functions.text import clean_text
from seekloom.operators.bm25_index import KeywordIndex
from seekloom.operators.keyword import attach_text, keyword_ranking
from seekloom.operators.lexicon import Lexicon
from seekloom.operators.terms import select_terms
from seekloom.operators.vectors import vector_topk, vector_topk_approx
from seekloom.plans.scratch import written
from seekloom.plans.sizing import QuerySize, measure_queries
from seekloom.plans.topk import top_k


def rrf_fuse(
    vector_hits: DataFrame, keyword_hits: DataFrame, config: FusionConfig = FusionConfig()
) -> DataFrame:
    """Fuse two ranked lists ``(query_id, chunk_id, rank)``.

    ``query_id, chunk_id, rrf_score, source_tag, rank``; the tag is ``KW``, ``VEC`` or
    ``KW+VEC``. Equal scores keep the vector order first, then the keyword order.
    """
    no_rank = F.lit(None).cast("int")
    lists = vector_hits.select(
        "query_id", "chunk_id", F.col("rank").alias("vector_rank"), no_rank.alias("keyword_rank")
    ).unionByName(
        keyword_hits.select(
            "query_id",
            "chunk_id",
            no_rank.alias("vector_rank"),
            F.col("rank").alias("keyword_rank"),
        )
    )
    contribution = reciprocal_rank(F.coalesce("vector_rank", "keyword_rank"), config.rrf_k)
    fused = lists.groupBy("query_id", "chunk_id").agg(
        F.sum(contribution).alias("rrf_score"),
        F.min("vector_rank").alias("vector_rank"),
        F.min("keyword_rank").alias("keyword_rank"),
    )
    tag = F.concat_ws(
        "+",
        F.when(F.col("keyword_rank").isNotNull(), F.lit("KW")),
        F.when(F.col("vector_rank").isNotNull(), F.lit("VEC")),
    )
    order = [
        F.round("rrf_score", 12).desc(),
        F.col("vector_rank").asc_nulls_last(),
        F.col("keyword_rank").asc_nulls_last(),
    ]
    # At most 2 * top_each rows per query, so one level is enough.
    return top_k(
        fused.withColumn("source_tag", tag),
        ["query_id"],
        order,
        config.top_n,
        spread_by="chunk_id",
        lanes=1,
    ).select("query_id", "chunk_id", "rrf_score", "source_tag", "rank")


def hybrid_search(
    queries: DataFrame,
    corpus: DataFrame,
    index: KeywordIndex,
    chunks: DataFrame,
    lexicon: Lexicon,
    fusion: FusionConfig = FusionConfig(),
    keyword: KeywordConfig = KeywordConfig(),
    with_text: bool = False,
    with_clean_text: bool = False,
    size: QuerySize | None = None,
    cell_model: KMeansModel | None = None,
    n_probe: int = 4,
) -> DataFrame:
    """Vector and keyword retrieval, fused.

    With ``cell_model`` the corpus is a cell table (with ``cell``) and only the cells next
    to a query are searched; without it every vector is.

    ``queries(query_id, query_text, query_vector)``. ``keyword.k`` is replaced by
    ``fusion.top_each``. With text, chunk columns (and ``text_clean``) are added.
    """
    size = size or measure_queries(queries)
    if cell_model is None:
        by_vector = vector_topk(queries, corpus, fusion.top_each, size)
    else:
        by_vector = vector_topk_approx(queries, corpus, cell_model, fusion.top_each, n_probe)
    settings = KeywordConfig(**{**keyword.__dict__, "k": fusion.top_each})
    kept = select_terms(queries, index, lexicon, settings, size)
    by_keyword = keyword_ranking(kept, index, settings, size)
    fused = rrf_fuse(by_vector, by_keyword, fusion)
    if not with_text:
        return fused
    # Used by the text lookup and the join back; stored so that the search runs once.
    found = attach_text(written(fused, "fused"), chunks, index.chunk_buckets)
    return found.withColumn("text_clean", clean_text("text")) if with_clean_text else found
