"""From questions to prompts and answers, for whole tables of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession

from seekloom.config import AnswerConfig, LakeConfig
from seekloom.operators.bm25_index import KeywordIndex
from seekloom.operators.fusion import hybrid_search
from seekloom.operators.lexicon import Lexicon
from seekloom.operators.prompts import eval_rows, generate_answers, prompt_table
from seekloom.operators.rerank import lexical_scores, rerank_topk
from seekloom.plans.ingest import stored_cell_model
from seekloom.plans.scratch import written
from seekloom.plans.sizing import measure_queries
from seekloom.sources.snapshots import current


def answer_inputs(
    queries: DataFrame,
    corpus: DataFrame,
    index: KeywordIndex,
    chunks: DataFrame,
    lexicon: Lexicon,
    config: AnswerConfig = AnswerConfig(),
    scorer: Callable[[DataFrame], DataFrame] = lexical_scores,
    cell_model: KMeansModel | None = None,
    n_probe: int = 4,
) -> DataFrame:
    """The reranked context of every query: hybrid search with text, then rerank."""
    fused = hybrid_search(
        queries,
        corpus,
        index,
        chunks,
        lexicon,
        config.fusion,
        config.keyword,
        with_text=True,
        size=measure_queries(queries),
        cell_model=cell_model,
        n_probe=n_probe,
    )
    return rerank_topk(fused, queries, scorer, config.rerank_top_k, config.candidate_limit)


def query_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Questions typed by a user as a query table, numbered from 1."""
    return spark.createDataFrame(
        list(enumerate(texts, start=1)), "query_id long, query_text string"
    )


def ask(
    spark: SparkSession,
    lake: LakeConfig,
    queries: DataFrame,
    generator: Callable,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    lexicon: Lexicon | None = None,
    config: AnswerConfig = AnswerConfig(),
    scorer: Callable[[DataFrame], DataFrame] = lexical_scores,
    n_probe: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Answer questions from the current version of a lake.

    A lake that has cells is searched by them, with the model stored beside them.

    Returns the reranked context and ``(query_id, answer)``. ``embed`` adds
    ``query_vector`` to queries that come without one.
    """
    if "query_vector" not in queries.columns:
        if embed is None:
            raise ValueError("queries need query_vector or an embed function")
        queries = written(embed(queries), "asked")
    snapshot = current(spark, lake)
    model = stored_cell_model(spark, snapshot)
    if model is None:
        corpus = snapshot.rows(spark, "wide").select("chunk_id", "embedding")
    else:
        corpus = snapshot.read(spark, "cells").select("chunk_id", "embedding", "cell")
    ranked = written(
        answer_inputs(
            queries,
            corpus,
            snapshot.index(spark),
            snapshot.read(spark, "chunks"),
            lexicon or Lexicon.from_terms(spark),
            config,
            scorer,
            model,
            n_probe,
        ),
        "context",
    )
    return ranked, generate_answers(prompt_table(queries, ranked), generator)


def run_questions(
    questions: DataFrame,
    ranked: DataFrame,
    generator: Callable,
    model: str,
) -> DataFrame:
    """Evaluation rows of all questions, given their reranked context."""
    answers = generate_answers(prompt_table(questions, ranked), generator)
    return eval_rows(questions, answers, model)
