"""Prompt assembly, answer generation with a caller-supplied model, evaluation rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekloom.plans.sizing import in_tasks
from seekloom.schemas import EVAL

# The instruction, the answer format and the refusal token.
SYSTEM_PROMPT = """You are a disaster risk domain expert.
You MUST answer using ONLY the provided CONTEXT (retrieved snippets).
Do NOT use outside knowledge. Do NOT guess. Do NOT fabricate citations.
If the CONTEXT does not contain enough information, reply exactly: OUT_OF_KNOWLEDGE
When you answer, be concise and factual."""
USER_HEADINGS = ("CONTEXT:", "QUESTION:", "RESPONSE FORMAT:\n- Answers:\n- Data sources:")

# A factory is called once per task and returns the model: chat messages -> answer.
Generator = Callable[[list[dict[str, str]]], str]


def context_table(ranked: DataFrame, rank_col: str = "rerank_rank") -> DataFrame:
    """``(query_id, context)``: the ranked texts as numbered snippets.

    Rows per query are bounded by the rerank cut.
    """
    snippets = F.array_sort(
        F.collect_list(F.struct(F.col(rank_col).alias("rank"), F.coalesce("text", F.lit("")).alias("text")))
    )
    return ranked.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                snippets,
                lambda row: F.concat(F.lit("["), row["rank"].cast("string"), F.lit("] "), row["text"]),
            ),
            "\n\n",
        ).alias("context")
    )


def prompt_table(
    queries: DataFrame,
    ranked: DataFrame,
    rank_col: str = "rerank_rank",
    instruction: str = SYSTEM_PROMPT,
    headings: tuple[str, str, str] = USER_HEADINGS,
) -> DataFrame:
    """``(query_id, messages)`` for every query, also for those without any context."""
    context, question, answer_format = headings
    user = F.concat(
        F.lit(f"{context}\n"),
        F.coalesce(F.col("context"), F.lit("")),
        F.lit(f"\n\n{question}\n"),
        F.coalesce(F.col("query_text"), F.lit("")),
        F.lit(f"\n\n{answer_format}"),
    )
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    return (
        queries.select("query_id", "query_text")
        .join(context_table(ranked, rank_col), "query_id", "left")
        .select("query_id", messages.alias("messages"))
    )


def generate_answers(
    prompts: DataFrame, factory: Callable[[], Generator], tasks: int | None = None
) -> DataFrame:
    """``(query_id, answer)`` from a model built once per task on the executors."""
    schema = T.StructType(
        [prompts.schema["query_id"], T.StructField("answer", T.StringType())]
    )

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            if not batch.num_rows:
                continue
            model = model or factory()
            answers = [model(messages) for messages in batch.column("messages").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), pa.array(answers, pa.string())],
                names=["query_id", "answer"],
            )

    return in_tasks(prompts, tasks).mapInArrow(generate, schema)


def eval_rows(questions: DataFrame, answers: DataFrame, model: str) -> DataFrame:
    """One row per (question, model); several models are simply appended.

    ``questions(query_id, query_text, fact, fact_source)``; ids keep their type.
    """
    fields = [T.StructField("question_id", questions.schema["query_id"].dataType), *EVAL.fields[1:]]
    return (
        questions.join(answers, "query_id", "left")
        .select(
            F.col("query_id").alias("question_id"),
            F.col("query_text").alias("question"),
            "fact",
            "fact_source",
            F.lit(model).alias("model"),
            "answer",
        )
        .to(T.StructType(fields))
    )


def append_eval(rows: DataFrame, name: str) -> None:
    """Append evaluation rows to a named table; runs of several models stand side by side."""
    rows.write.mode("append").saveAsTable(name)
