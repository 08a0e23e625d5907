"""Reranking of fused candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekloom.functions.analyzer import query_tokens
from seekloom.plans.sizing import in_tasks
from seekloom.plans.topk import top_k

# A factory is called once per task and returns the model: (queries, texts) -> scores.
PairModel = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def score_pairs(
    frame: DataFrame,
    factory: Callable[[], PairModel],
    query_col: str = "query_text",
    text_col: str = "text",
    score_col: str = "rerank_score",
    batch_size: int = 16,
    tasks: int | None = None,
) -> DataFrame:
    """Add the model's relevance for each (query, text) row; null text counts as "".

    The rows are dealt over ``tasks`` tasks, by default the shuffle width, which adaptive
    execution does not merge. Within a task they are ordered by the length of query and text
    together, so the pairs of a batch are of like length and little of a batch is padding.
    """
    length = F.coalesce(F.length(query_col), F.lit(0)) + F.coalesce(F.length(text_col), F.lit(0))
    dealt = in_tasks(frame, tasks).sortWithinPartitions(length, F.xxhash64(query_col, text_col))
    schema = T.StructType([*frame.schema.fields, T.StructField(score_col, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            asked = [value or "" for value in batch.column(query_col).to_pylist()]
            texts = [value or "" for value in batch.column(text_col).to_pylist()]
            if not texts:
                continue
            model = model or factory()
            scores: list[float] = []
            for start in range(0, len(texts), batch_size):
                part = slice(start, start + batch_size)
                scores.extend(float(value) for value in model(asked[part], texts[part]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())],
                names=[*batch.schema.names, score_col],
            )

    return dealt.mapInArrow(score, schema)


def lexical_scores(
    frame: DataFrame,
    query_col: str = "query_text",
    text_col: str = "text",
    score_col: str = "rerank_score",
) -> DataFrame:
    """Baseline without a model: the share of distinct query tokens found in the text."""
    asked = query_tokens(query_col)
    shared = F.size(F.array_intersect(asked, query_tokens(text_col)))
    return frame.withColumn(
        score_col,
        F.when(F.size(asked) > 0, shared / F.size(asked)).otherwise(F.lit(0.0)),
    )


def rerank_topk(
    candidates: DataFrame,
    queries: DataFrame,
    scorer: Callable[[DataFrame], DataFrame] = lexical_scores,
    top_k_rows: int = 10,
    candidate_limit: int | None = 50,
    score_col: str = "rerank_score",
) -> DataFrame:
    """Score the first ``candidate_limit`` candidates of each query and keep the best.

    ``candidates`` carry ``query_id`` and ``rank``; the new order is ``rerank_rank``.
    Equal scores keep their candidate order. ``scorer`` adds ``score_col`` to rows with
    ``query_text`` and ``text``. All candidate columns are kept.
    """
    if candidate_limit:
        candidates = candidates.filter(F.col("rank") <= candidate_limit)
    paired = candidates.join(queries.select("query_id", "query_text"), "query_id")
    scored = scorer(paired).drop("query_text")
    order = [F.round(score_col, 8).desc(), F.col("rank").asc()]
    return top_k(
        scored, ["query_id"], order, top_k_rows, spread_by="chunk_id", rank="rerank_rank", lanes=1
    )
