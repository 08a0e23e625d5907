"""One entry per operator, each over the whole bundled tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekloom.config import AnswerConfig, Budget, FusionConfig, KeywordConfig
from seekloom.config import LakeConfig
from seekloom.functions.analyzer import document_tokens
from seekloom.functions.text import basename, clean_text, english_ratio
from seekloom.functions.vectors import l2_norm
from seekloom.operators import audit, bm25_index, bm25_update, cell_tree, keyword, prompts, terms, vectors
from seekloom.operators.embed import embed_hashed, embed_texts
from seekloom.operators.fusion import hybrid_search, rrf_fuse
from seekloom.operators.rerank import lexical_scores, rerank_topk
from seekloom.operators.upsert import latest_per_key, upsert, wide_after_batch, wide_table
from seekloom.plans.answers import answer_inputs, run_questions
from seekloom.plans.scratch import scratch_path, written
from seekloom.plans.sizing import QuerySize, measure_queries
from seekloom.sources.chunks import read_chunks
from seekloom.sources.shards import read_embedding_shards
from seekloom.plans.ingest import ingest
from seekloom.sources.snapshots import compact, current, remove_superseded
from seekloom.streaming.ingest_stream import start_ingest_stream, start_vector_stream
from seekloom.workload import inputs

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
KEYWORD = KeywordConfig()
STRICT = KeywordConfig(english_ratio_min=0.70, k=20, oversample=2, filter_first=False)
FALLBACK = KeywordConfig(min_terms=12)
FUSION = FusionConfig()


def register(function: Query) -> Query:
    """Register a query under its function name, without the ``_query`` that avoids a clash."""
    REGISTERED[function.__name__.removesuffix("_query")] = function
    return function


def with_positions(frame: DataFrame) -> DataFrame:
    """Vectors as one row per element, so that they compare exactly."""
    return frame.select("chunk_id", F.posexplode("embedding").alias("position", "value")).select(
        "chunk_id", "position", F.col("value").cast("double").alias("value")
    )


def vector_digest(column: str = "embedding"):
    """An order-sensitive digest of a vector."""
    return F.round(
        F.aggregate(
            F.transform(column, lambda value, i: value.cast("double") * (i + 1)),
            F.lit(0.0),
            lambda total, value: total + value,
        ),
        6,
    )


# Sources and text columns


@register
def chunks_scan(spark, sf_dir):
    path = scratch_path(spark, "chunk-files")
    inputs.chunks(spark, sf_dir).write.json(path)
    return read_chunks(spark, path)


@register
def embeddings_decode(spark, sf_dir):
    return with_positions(read_embedding_shards(spark, inputs.shard_base(spark, sf_dir), inputs.MODEL))


@register
def source_basename(spark, sf_dir):
    return inputs.chunks(spark, sf_dir).select("chunk_id", basename("source_file").alias("file_name"))


@register
def text_clean(spark, sf_dir):
    return inputs.chunks(spark, sf_dir).select("chunk_id", clean_text("text").alias("text_clean"))


@register
def english_ratio_query(spark, sf_dir):
    ratio = english_ratio("text")
    return inputs.chunks(spark, sf_dir).select(
        "chunk_id", F.round(ratio, 6).alias("ratio"), (ratio >= 0.7).alias("kept")
    )


# Keyword index


@register
def tokens(spark, sf_dir):
    return inputs.chunks(spark, sf_dir).select(
        "chunk_id", F.posexplode(document_tokens("text")).alias("position", "term")
    )


@register
def bm25_postings(spark, sf_dir):
    return bm25_index.postings(inputs.chunks(spark, sf_dir)).select("term", "chunk_id", "tf")


@register
def bm25_postings_capitals_split(spark, sf_dir):
    return bm25_index.postings(inputs.chunks(spark, sf_dir), lower_first=False).select(
        "term", "chunk_id", "tf"
    )


@register
def bm25_doc_stats(spark, sf_dir):
    return bm25_index.doc_stats(inputs.chunks(spark, sf_dir))


@register
def bm25_df(spark, sf_dir):
    return bm25_index.build_index(inputs.chunks(spark, sf_dir)).df


@register
def bm25_meta(spark, sf_dir):
    return bm25_index.build_index(inputs.chunks(spark, sf_dir)).meta.select(
        "N", F.round("avgdl", 6).alias("avgdl")
    )


@register
def bm25_index_wide_scope(spark, sf_dir):
    scope = bm25_index.index_scope(
        inputs.chunks(spark, sf_dir), inputs.embeddings(spark, sf_dir), "wide"
    )
    return bm25_index.build_index(scope).df


@register
def bm25_idf(spark, sf_dir):
    index = inputs.index(spark, sf_dir)
    n_chunks = index.meta.select(F.col("N").cast("double")).scalar()
    return index.df.select("term", "df", F.round(terms.idf(n_chunks, F.col("df")), 6).alias("idf"))


# Query terms


@register
def query_tokens(spark, sf_dir):
    return terms.query_terms(inputs.queries(spark, sf_dir))


@register
def query_boosts(spark, sf_dir):
    return terms.weighted_terms(
        inputs.queries(spark, sf_dir), inputs.lexicon(spark, sf_dir)
    ).select("query_id", "term", "boost")


@register
def term_weights(spark, sf_dir):
    return terms.weighted_terms(
        inputs.queries(spark, sf_dir), inputs.lexicon(spark, sf_dir)
    ).select("query_id", "term", "whitelisted", F.round("term_weight", 6).alias("term_weight"))


def _selected(spark, sf_dir, config):
    return terms.select_terms(
        inputs.queries(spark, sf_dir),
        inputs.index(spark, sf_dir),
        inputs.lexicon(spark, sf_dir),
        config,
    ).select("query_id", "term", "df", "used_fallback")


@register
def query_terms_selected(spark, sf_dir):
    return _selected(spark, sf_dir, KEYWORD)


@register
def query_terms_fallback(spark, sf_dir):
    return _selected(spark, sf_dir, FALLBACK)


# Keyword search


@register
def bm25_term_scores(spark, sf_dir):
    queries, index = inputs.queries(spark, sf_dir), inputs.index(spark, sf_dir)
    size = measure_queries(queries)
    kept = terms.select_terms(queries, index, inputs.lexicon(spark, sf_dir), KEYWORD, size)
    scored = keyword.term_scores(kept, index, KEYWORD, size.terms_fit()).drop("english_ratio")
    return scored.withColumn(
        "bm25_term", F.round("bm25_term", 6)
    )


@register
def bm25_topk(spark, sf_dir):
    queries, index = inputs.queries(spark, sf_dir), inputs.index(spark, sf_dir)
    size = measure_queries(queries)
    kept = terms.select_terms(queries, index, inputs.lexicon(spark, sf_dir), KEYWORD, size)
    pool = KEYWORD.k * KEYWORD.oversample
    return keyword.candidates(kept, index, pool, KEYWORD, size).withColumn(
        "score", F.round("score", 6)
    )


def _keyword_search(spark, sf_dir, config, size=None):
    return (
        keyword.keyword_search(
            inputs.queries(spark, sf_dir),
            inputs.index(spark, sf_dir),
            inputs.stored(spark, sf_dir),
            inputs.lexicon(spark, sf_dir),
            config,
            size,
        )
        .withColumn("matched_terms", F.array_join("matched_terms", " "))
        .withColumn("score", F.round("score", 6))
    )


@register
def keyword_search(spark, sf_dir):
    return _keyword_search(spark, sf_dir, KEYWORD)


@register
def keyword_search_language_filter(spark, sf_dir):
    return _keyword_search(spark, sf_dir, STRICT)


@register
def keyword_search_filter_first(spark, sf_dir):
    return _keyword_search(spark, sf_dir, replace(STRICT, filter_first=True))


@register
def matched_terms(spark, sf_dir):
    return _keyword_search(spark, sf_dir, KEYWORD).select("query_id", "chunk_id", "matched_terms")


# Vectors


@register
def vector_topk(spark, sf_dir):
    return vectors.vector_topk(
        inputs.queries(spark, sf_dir), inputs.embeddings(spark, sf_dir)
    ).withColumn("search_score", F.round("search_score", 6))


@register
def vector_topk_all_pairs_of_ids(spark, sf_dir):
    corpus = inputs.embeddings(spark, sf_dir)
    asked = corpus.select(
        F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    return vectors.vector_topk(asked, corpus).withColumn(
        "search_score", F.round("search_score", 6)
    )


@register
def vector_search(spark, sf_dir):
    return vectors.vector_search(
        inputs.queries(spark, sf_dir),
        inputs.embeddings(spark, sf_dir),
        inputs.stored(spark, sf_dir),
    ).withColumn("search_score", F.round("search_score", 6))


@register
def vector_topk_approx(spark, sf_dir):
    model, index = inputs.cells(spark, sf_dir)
    return vectors.vector_topk_approx(inputs.queries(spark, sf_dir), index, model)


@register
def vector_topk_approx_all_cells(spark, sf_dir):
    model, index = inputs.cells(spark, sf_dir)
    return vectors.vector_topk_approx(
        inputs.queries(spark, sf_dir), index, model, n_probe=inputs.CELLS
    ).withColumn("search_score", F.round("search_score", 6))


# Query tables beyond the budget, on the paths that shuffle or go block by block


@register
def keyword_search_large_query_table(spark, sf_dir):
    return _keyword_search(spark, sf_dir, KEYWORD, QuerySize(10**9, 10**9, 10**12, 0))


@register
def vector_topk_query_blocks(spark, sf_dir):
    return vectors.vector_topk(
        inputs.queries(spark, sf_dir), inputs.embeddings(spark, sf_dir), budget=Budget(0, 0)
    ).withColumn("search_score", F.round("search_score", 6))


@register
def vector_topk_approx_query_blocks(spark, sf_dir):
    model, index = inputs.cells(spark, sf_dir)
    return vectors.vector_topk_approx(
        inputs.queries(spark, sf_dir), index, model, n_probe=inputs.CELLS, budget=Budget(0, 0)
    ).withColumn("search_score", F.round("search_score", 6))


# Cells in two levels, and what approximate results must keep


@register
def vector_topk_tree_all_cells(spark, sf_dir):
    tree, index = inputs.cell_tree(spark, sf_dir)
    cells = tree.fine.count()
    return cell_tree.vector_topk_tree(
        inputs.queries(spark, sf_dir), index, tree, n_probe=cells, n_coarse=inputs.TREE_COARSE
    ).withColumn("search_score", F.round("search_score", 6))


def _properties(spark, sf_dir, found):
    """Per approximate result: its queries, whether all scores are exact, and whether recall is 0.9."""
    queries, corpus = inputs.queries(spark, sf_dir), inputs.embeddings(spark, sf_dir)
    found = written(found, "approximate")
    exact = vectors.vector_topk(queries, corpus).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    asked = queries.select(F.col("query_id").alias("_query"), "query_vector")
    own = F.aggregate(
        F.zip_with("query_vector", "embedding", lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, part: total + part,
    )
    checked = found.join(asked, F.col("query_id") == F.col("_query")).join(corpus, "chunk_id")
    checked = checked.join(exact, ["query_id", "chunk_id"], "left")
    wanted = exact.count()
    return checked.agg(
        F.count_distinct("query_id").alias("queries"),
        F.min(F.abs(own - F.col("search_score")) < 1e-6).alias("scores_exact"),
        F.sum("hit").alias("hits"),
    ).select("queries", "scores_exact", (F.col("hits") >= 0.9 * wanted).alias("recall_kept"))


@register
def vector_topk_approx_properties(spark, sf_dir):
    model, index = inputs.cells(spark, sf_dir)
    found = vectors.vector_topk_approx(inputs.queries(spark, sf_dir), index, model, n_probe=12)
    return _properties(spark, sf_dir, found)


@register
def vector_topk_tree_properties(spark, sf_dir):
    tree, index = inputs.cell_tree(spark, sf_dir)
    probes = -(-3 * tree.fine.count() // 4)
    found = cell_tree.vector_topk_tree(
        inputs.queries(spark, sf_dir), index, tree, n_probe=probes, n_coarse=inputs.TREE_COARSE
    )
    return _properties(spark, sf_dir, found)


def _in_nearest_cell(model):
    """Whether no centre is closer to a vector than that of its cell."""

    def distance(center):
        parts = F.zip_with(
            "embedding", F.array(*(F.lit(float(x)) for x in center)), lambda x, y: (x - y) * (x - y)
        )
        return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)

    distances = F.array(*(distance(center) for center in model.clusterCenters()))
    return F.get(distances, F.col("cell")) <= F.array_min(distances) + F.lit(1e-6)


@register
def vector_index_refresh(spark, sf_dir):
    model, index = inputs.cells(spark, sf_dir)
    refreshed = vectors.refresh_cells(
        index,
        latest_per_key(inputs.batch_embeddings(spark, sf_dir)),
        model,
        inputs.batch_fits(spark, sf_dir),
    )
    return refreshed.select(
        "chunk_id",
        vector_digest().alias("digest"),
        F.round(l2_norm("embedding"), 4).alias("norm"),
        _in_nearest_cell(model).alias("in_nearest_cell"),
    )


@register
def embed_texts_query(spark, sf_dir):
    asked = inputs.queries(spark, sf_dir).select("query_id", "query_text")
    return embed_texts(asked, inputs.counting_model).select(
        "query_id", *[F.round(F.get("query_vector", i).cast("double"), 4).alias(f"v{i}") for i in range(4)]
    )


@register
def embed_text_hashed(spark, sf_dir):
    asked = inputs.queries(spark, sf_dir).select("query_id", "query_text")
    return embed_hashed(asked, 64).select(
        "query_id",
        F.size("query_vector").alias("dim"),
        F.round(l2_norm("query_vector"), 4).alias("norm"),
    )


# Fusion, rerank, prompts


@register
def rrf_fuse_query(spark, sf_dir):
    queries = inputs.queries(spark, sf_dir)
    index, size = inputs.index(spark, sf_dir), measure_queries(queries)
    kept = terms.select_terms(queries, index, inputs.lexicon(spark, sf_dir), KEYWORD, size)
    by_keyword = keyword.candidates(kept, index, FUSION.top_each, KEYWORD, size)
    by_vector = vectors.vector_topk(queries, inputs.embeddings(spark, sf_dir), FUSION.top_each, size)
    return rrf_fuse(by_vector, by_keyword, FUSION).withColumn("rrf_score", F.round("rrf_score", 9))


def _hybrid(spark, sf_dir, **options):
    return hybrid_search(
        inputs.queries(spark, sf_dir),
        inputs.embeddings(spark, sf_dir),
        inputs.index(spark, sf_dir),
        inputs.stored(spark, sf_dir),
        inputs.lexicon(spark, sf_dir),
        **options,
    ).withColumn("rrf_score", F.round("rrf_score", 9))


@register
def hybrid_search_query(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@register
def hybrid_search_approx_all_cells(spark, sf_dir):
    model, index = inputs.cells(spark, sf_dir)
    return hybrid_search(
        inputs.queries(spark, sf_dir),
        index,
        inputs.index(spark, sf_dir),
        inputs.stored(spark, sf_dir),
        inputs.lexicon(spark, sf_dir),
        cell_model=model,
        n_probe=inputs.CELLS,
    ).withColumn("rrf_score", F.round("rrf_score", 9))


@register
def hybrid_with_text(spark, sf_dir):
    return _hybrid(spark, sf_dir, with_text=True, with_clean_text=True)


@register
def rerank_lexical(spark, sf_dir):
    queries = inputs.queries(spark, sf_dir)
    fused = _hybrid(spark, sf_dir, with_text=True)
    paired = fused.join(queries.select("query_id", "query_text"), "query_id")
    return lexical_scores(paired).select(
        "query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score")
    )


@register
def rerank_topk_query(spark, sf_dir):
    fused = _hybrid(spark, sf_dir, with_text=True)
    return rerank_topk(fused, inputs.queries(spark, sf_dir), top_k_rows=5, candidate_limit=8).select(
        "query_id",
        "chunk_id",
        "rank",
        "rerank_rank",
        "text",
        F.round("rerank_score", 6).alias("rerank_score"),
    )


def _context(spark, sf_dir):
    return answer_inputs(
        inputs.queries(spark, sf_dir),
        inputs.embeddings(spark, sf_dir),
        inputs.index(spark, sf_dir),
        inputs.stored(spark, sf_dir),
        inputs.lexicon(spark, sf_dir),
        AnswerConfig(),
    )


@register
def rag_context(spark, sf_dir):
    return _context(spark, sf_dir).select(
        "query_id",
        "rerank_rank",
        "chunk_id",
        F.round("rerank_score", 6).alias("rerank_score"),
        F.round("rrf_score", 9).alias("rrf_score"),
        "source_tag",
        "source_file",
        "chunk_index_in_file",
        "text",
    )


@register
def prompt_table(spark, sf_dir):
    asked = inputs.queries(spark, sf_dir)
    return prompts.prompt_table(asked, _context(spark, sf_dir)).select(
        "query_id", F.inline("messages")
    )


def digest_generator():
    """A stand-in answer model: the MD5 of the user message, so every character counts."""
    import hashlib

    return lambda messages: hashlib.md5(messages[-1]["content"].encode()).hexdigest()


@register
def eval_rows(spark, sf_dir):
    asked = inputs.queries(spark, sf_dir).withColumns(
        {"fact": F.lit(None).cast("string"), "fact_source": F.lit("benchmark")}
    )
    rows = run_questions(asked, _context(spark, sf_dir), digest_generator, "digest")
    return written(rows, "eval-rows")


# Upserts and incremental index


@register
def wide_table_query(spark, sf_dir):
    joined = wide_table(inputs.chunks(spark, sf_dir), inputs.embeddings(spark, sf_dir))
    return joined.withColumn("digest", vector_digest()).drop("embedding")


def _chunks_after(spark, sf_dir):
    batch = latest_per_key(inputs.batch_chunks(spark, sf_dir), prefer=["text"])
    return upsert(inputs.chunks(spark, sf_dir), batch, inputs.batch_fits(spark, sf_dir))


def _embeddings_after(spark, sf_dir):
    batch = latest_per_key(inputs.batch_embeddings(spark, sf_dir))
    return upsert(inputs.embeddings(spark, sf_dir), batch, inputs.batch_fits(spark, sf_dir))


@register
def upsert_chunks(spark, sf_dir):
    return _chunks_after(spark, sf_dir)


@register
def upsert_embeddings(spark, sf_dir):
    return with_positions(_embeddings_after(spark, sf_dir))


@register
def upsert_wide(spark, sf_dir):
    base = wide_table(inputs.chunks(spark, sf_dir), inputs.embeddings(spark, sf_dir))
    ids = (
        inputs.batch_chunks(spark, sf_dir)
        .select("chunk_id")
        .unionByName(inputs.batch_embeddings(spark, sf_dir).select("chunk_id"))
        .distinct()
    )
    after = wide_after_batch(
        base,
        _chunks_after(spark, sf_dir),
        _embeddings_after(spark, sf_dir),
        ids,
        inputs.batch_fits(spark, sf_dir),
    )
    return after.withColumn("digest", vector_digest()).drop("embedding")


def _index_after(spark, sf_dir):
    batch = latest_per_key(inputs.batch_chunks(spark, sf_dir), prefer=["text"])
    return bm25_update.update_index(
        inputs.index(spark, sf_dir), batch, inputs.batch_fits(spark, sf_dir)
    )


@register
def bm25_df_delta(spark, sf_dir):
    batch = latest_per_key(inputs.batch_chunks(spark, sf_dir), prefer=["text"])
    old = bm25_update.affected_postings(
        inputs.index(spark, sf_dir), batch, inputs.batch_fits(spark, sf_dir)
    )
    return bm25_update.df_delta(old, bm25_index.postings(batch))


@register
def bm25_postings_incremental(spark, sf_dir):
    return _index_after(spark, sf_dir).postings.select("term", "chunk_id", "tf")


@register
def bm25_doc_stats_incremental(spark, sf_dir):
    return _index_after(spark, sf_dir).doc_stats


@register
def bm25_df_incremental(spark, sf_dir):
    return _index_after(spark, sf_dir).df


@register
def bm25_meta_incremental(spark, sf_dir):
    return _index_after(spark, sf_dir).meta.select("N", F.round("avgdl", 6).alias("avgdl"))


@register
def ingest_report(spark, sf_dir):
    report, _ = inputs.ingested(spark, sf_dir)
    return report


def _with_rounded_ratio(postings):
    return postings.withColumn("english_ratio", F.round("english_ratio", 6))


@register
def ingest_postings(spark, sf_dir):
    _, snapshot = inputs.ingested(spark, sf_dir)
    return _with_rounded_ratio(snapshot.rows(spark, "postings"))


@register
def ingest_after_skipped_update(spark, sf_dir):
    lake = LakeConfig(scratch_path(spark, "skipping-lake"), chunk_buckets=2, term_buckets=2)
    first, second = inputs.chunks(spark, sf_dir), inputs.batch_chunks(spark, sf_dir)
    ingest(spark, lake, first)
    turns = F.col("chunk_id").startswith("c")
    ingest(spark, lake, second.filter(turns), update_keyword_index=False)
    ingest(spark, lake, second.filter(~turns))
    return current(spark, lake).rows(spark, "df")


@register
def ingest_compacted(spark, sf_dir):
    _, snapshot = inputs.ingested(spark, sf_dir)
    lake = snapshot.lake
    # The shared lake stays as it is: its tables are ingested into one of its own.
    own = LakeConfig(scratch_path(spark, "compact-lake"), chunk_buckets=2, term_buckets=2)
    ingest(spark, own, snapshot.rows(spark, "chunks"))
    ingest(spark, own, inputs.batch_chunks(spark, sf_dir))
    compacted = compact(spark, replace(lake, root=own.root))
    remove_superseded(spark, own)
    return _with_rounded_ratio(compacted.rows(spark, "postings"))


@register
def ingest_cells(spark, sf_dir):
    model, _ = inputs.cells(spark, sf_dir)
    lake = LakeConfig(scratch_path(spark, "cell-lake"), chunk_buckets=2, term_buckets=2)
    ingest(spark, lake, inputs.chunks(spark, sf_dir), inputs.embeddings(spark, sf_dir), cell_model=model)
    ingest(spark, lake, inputs.batch_chunks(spark, sf_dir), inputs.batch_embeddings(spark, sf_dir))
    return current(spark, lake).rows(spark, "cells").select(
        "chunk_id", F.round(l2_norm("embedding"), 4).alias("norm")
    )


@register
def ingest_stream(spark, sf_dir):
    folder = scratch_path(spark, "incoming")
    checkpoint = scratch_path(spark, "stream-state")
    lake = LakeConfig(scratch_path(spark, "stream-lake"), chunk_buckets=2, term_buckets=2)
    for arriving in (inputs.chunks(spark, sf_dir), inputs.batch_chunks(spark, sf_dir)):
        arriving.write.mode("append").json(folder)
        start_ingest_stream(spark, folder, lake, checkpoint).awaitTermination()
    return current(spark, lake).rows(spark, "df")


def _streamed(spark, sf_dir):
    """Chunks and vectors of both batches through two streams, the vectors of the first one ahead."""

    def build():
        model, _ = inputs.cells(spark, sf_dir)
        folder, lake_root = scratch_path(spark, "two-sources"), scratch_path(spark, "two-source-lake")
        lake = LakeConfig(lake_root, chunk_buckets=2, term_buckets=2)
        start_vector_stream(
            spark, inputs.shard_base(spark, sf_dir), inputs.MODEL, lake, scratch_path(spark, "vector-state")
        ).awaitTermination()
        checkpoint = scratch_path(spark, "chunk-state")
        inputs.chunks(spark, sf_dir).write.mode("append").json(folder)
        start_ingest_stream(spark, folder, lake, checkpoint, cell_model=model).awaitTermination()
        return current(spark, lake)

    return inputs.once(spark, sf_dir, "streamed", build)


@register
def ingest_two_streams_wide(spark, sf_dir):
    wide = _streamed(spark, sf_dir).rows(spark, "wide")
    return wide.withColumn("norm", F.round(l2_norm("embedding"), 4)).drop("embedding")


@register
def ingest_two_streams_cells(spark, sf_dir):
    cells = _streamed(spark, sf_dir).rows(spark, "cells")
    return cells.select("chunk_id", F.round(l2_norm("embedding"), 4).alias("norm"))


# Audits


@register
def coverage_audit(spark, sf_dir):
    chunk_rows, vector_rows = inputs.chunks(spark, sf_dir), inputs.embeddings(spark, sf_dir)
    return audit.coverage(
        inputs.batch_chunks(spark, sf_dir),
        {
            "in_text": chunk_rows,
            "in_emb": vector_rows,
            "in_wide": wide_table(chunk_rows, vector_rows),
        },
    )


@register
def coverage_audit_sql(spark, sf_dir):
    chunk_rows, vector_rows = inputs.chunks(spark, sf_dir), inputs.embeddings(spark, sf_dir)
    return audit.coverage_sql(
        inputs.batch_chunks(spark, sf_dir),
        chunk_rows,
        vector_rows,
        wide_table(chunk_rows, vector_rows),
    )


@register
def match_audit(spark, sf_dir):
    return audit.match_audit(inputs.chunks(spark, sf_dir), inputs.embeddings(spark, sf_dir))


@register
def source_files(spark, sf_dir):
    return audit.source_files(inputs.chunks(spark, sf_dir))
