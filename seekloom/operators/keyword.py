"""BM25 keyword search for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekloom.config import KeywordConfig
from seekloom.functions.scoring import bm25_term
from seekloom.operators.bm25_index import BUCKETED, KeywordIndex, bucketed_ids
from seekloom.operators.lexicon import Lexicon
from seekloom.operators.terms import select_terms
from seekloom.plans.joins import join_by_known_rows
from seekloom.plans.scratch import written
from seekloom.plans.sizing import QuerySize, keys_fit, measure_queries
from seekloom.plans.topk import by_score, top_k
from seekloom.schemas import TEXT_COLUMNS


def term_scores(
    kept: DataFrame, index: KeywordIndex, config: KeywordConfig, fits: bool, filtered: bool = False
) -> DataFrame:
    """``(query_id, chunk_id, term, tf, english_ratio, bm25_term)`` for every posting of a kept term.

    ``kept`` carries idf and weight, so a posting needs this one join only; where it shuffles,
    the document frequencies say which terms are dealt over lanes. With ``filtered`` postings of chunks with too few ASCII letters are left out by the scan.
    """
    avgdl = index.meta.select("avgdl").scalar()
    found = index.postings
    if filtered:
        found = found.filter(F.col("english_ratio") >= config.english_ratio_min)
    side, keys = index.with_term_bucket(
        kept.select("query_id", "term", "idf", "term_weight"), index.postings
    )
    known = index.df.select("term", F.col("df").alias("rows"))
    return join_by_known_rows(found, side, keys, known, "term", "chunk_id", fits).select(
        "query_id",
        "chunk_id",
        "term",
        "tf",
        "english_ratio",
        bm25_term(
            F.col("idf"),
            F.col("tf"),
            F.col("doc_len"),
            avgdl,
            F.col("term_weight"),
            config.k1,
            config.b,
        ).alias("bm25_term"),
    )


def best_terms(count: int) -> Column:
    """An aggregate over the scored postings of a chunk: its best terms, best first, as ``term(tf)``.

    The list never holds more than one entry per term of the query, and ``count`` in the end.
    """
    entries = F.array_sort(
        F.collect_list(F.struct((-F.round("bm25_term", 8)).alias("order"), F.col("term"), F.col("tf")))
    )
    return F.transform(
        F.slice(entries, 1, count),
        lambda entry: F.concat(entry["term"], F.lit("("), entry["tf"].cast("string"), F.lit(")")),
    )


def chunk_scores(scored: DataFrame, min_terms: int, top_terms: int = 0) -> DataFrame:
    """``(query_id, chunk_id, score, hit_terms, english_ratio)`` for chunks with enough matching terms.

    Score, hit count and, with ``top_terms``, the ``matched_terms`` come from one aggregate; a
    term occurs once per chunk, so counting rows counts distinct terms.
    """
    named = [best_terms(top_terms).alias("matched_terms")] if top_terms else []
    return (
        scored.groupBy("query_id", "chunk_id")
        .agg(
            F.sum("bm25_term").alias("score"),
            F.count(F.lit(1)).alias("hit_terms"),
            F.max("english_ratio").alias("english_ratio"),
            *named,
        )
        .filter(F.col("hit_terms") >= min_terms)
    )


def attach_text(
    hits: DataFrame, chunks: DataFrame, chunk_buckets: int = 0, how: str = "left"
) -> DataFrame:
    """Add text columns to stored hits without moving the chunk table.

    When the hits fit a broadcast, the chunk table is cut down to them where it lies,
    reading only their buckets if it is bucketed, and what is left is joined to the
    hits. Hits without a chunk keep null text, or go with ``how="inner"``.
    """
    wanted, keys = chunks.select("chunk_id", *TEXT_COLUMNS), ["chunk_id"]
    if chunk_buckets and "chunk_bucket" in chunks.columns:
        wanted, keys = chunks.select("chunk_bucket", "chunk_id", *TEXT_COLUMNS), BUCKETED
    if keys_fit(hits, "chunk_id"):
        ids, _ = bucketed_ids(hits.select("chunk_id").distinct(), chunk_buckets)
        wanted = wanted.join(F.broadcast(ids.select(*keys)), keys, "left_semi")
    return hits.join(wanted.select("chunk_id", *TEXT_COLUMNS), "chunk_id", how)


def candidates(
    kept: DataFrame, index: KeywordIndex, k: int, config: KeywordConfig, size: QuerySize
) -> DataFrame:
    """The best ``k`` chunks per query by score: ``query_id, chunk_id, score, hit_terms, rank``."""
    scored = term_scores(kept, index, config, size.terms_fit())
    return top_k(
        chunk_scores(scored, config.min_terms).drop("english_ratio"),
        ["query_id"],
        by_score("score"),
        k,
        spread_by="chunk_id",
    )


def keyword_ranking(
    kept: DataFrame,
    index: KeywordIndex,
    config: KeywordConfig,
    size: QuerySize,
    top_terms: int = 0,
) -> DataFrame:
    """``query_id, chunk_id, score, rank``: scored chunks, language filter, final cut.

    With ``top_terms`` also the ``matched_terms``, from the same pass over the postings.
    With ``filter_first`` the postings of chunks that fail the language filter are not read
    further, so ``k`` rows remain whenever that many qualify. Without it the best
    ``k * oversample`` are cut first and fewer may remain. Neither reads the chunk table.
    """
    filtered = config.english_ratio_min is not None
    first = filtered and config.filter_first
    scored = term_scores(kept, index, config, size.terms_fit(), first)
    found = chunk_scores(scored, config.min_terms, top_terms).drop("hit_terms")
    lanes = None
    if filtered and not first:
        pool = config.k * config.oversample
        found = top_k(found, ["query_id"], by_score("score"), pool, spread_by="chunk_id")
        found = found.filter(F.col("english_ratio") >= config.english_ratio_min).drop("rank")
        lanes = 1
    found = found.drop("english_ratio")
    return top_k(found, ["query_id"], by_score("score"), config.k, spread_by="chunk_id", lanes=lanes)


def keyword_search(
    queries: DataFrame,
    index: KeywordIndex,
    chunks: DataFrame,
    lexicon: Lexicon,
    config: KeywordConfig = KeywordConfig(),
    size: QuerySize | None = None,
) -> DataFrame:
    """Full keyword search result for ``queries(query_id, query_text)``.

    ``query_id, rank, chunk_id, matched_terms, text, source_file, chunk_index_in_file,
    score``. Queries without any token simply have no rows. The postings are read once. The
    ranking is stored, as it decides which texts are fetched. A hit whose chunk is gone has no
    text; with a language filter it is left out.
    """
    size = size or measure_queries(queries)
    kept = select_terms(queries, index, lexicon, config, size)
    ranked = written(keyword_ranking(kept, index, config, size, config.top_terms), "ranked")
    how = "left" if config.english_ratio_min is None else "inner"
    return attach_text(ranked, chunks, index.chunk_buckets, how).select(
        "query_id", "rank", "chunk_id", "matched_terms", *TEXT_COLUMNS, "score"
    )
