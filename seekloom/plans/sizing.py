"""Size checks that decide between a broadcast and a shuffle.

A frame is broadcast only after its rows and bytes were measured. Measuring reads the
small side alone (the query table, one ingest batch), never the index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekloom.config import DEFAULT_BUDGET, Budget
from seekloom.functions.analyzer import query_tokens

ROW_OVERHEAD = 64  # bytes for ids, numbers and the hash slot of one broadcast row


@dataclass(frozen=True)
class QuerySize:
    """Measured size of a query table; ``text_bytes`` counts the id once per term."""

    rows: int
    terms: int
    text_bytes: int
    vector_values: int

    def terms_fit(self, budget: Budget = DEFAULT_BUDGET) -> bool:
        """Whether one row per query term stays within the budget."""
        size = self.text_bytes + self.terms * ROW_OVERHEAD
        return self.terms <= budget.max_rows and size <= budget.max_bytes

    def vectors_fit(self, budget: Budget = DEFAULT_BUDGET) -> bool:
        """Whether all query vectors as doubles stay within the budget."""
        size = self.vector_values * 8 + self.text_bytes + self.rows * ROW_OVERHEAD
        return self.rows <= budget.max_rows and size <= budget.max_bytes


def measure_queries(queries: DataFrame) -> QuerySize:
    """Measure a query table in one aggregate over that table."""
    zero = F.lit(0).cast("long")
    text = F.col("query_text") if "query_text" in queries.columns else F.lit(None).cast("string")
    vector = (
        F.size("query_vector") if "query_vector" in queries.columns else F.lit(None).cast("int")
    )
    measured = queries.select(
        F.size(query_tokens(text)).alias("terms"),
        F.coalesce(F.octet_length(text), F.lit(0)).alias("text_bytes"),
        F.octet_length(F.col("query_id").cast("string")).alias("id_bytes"),
        vector.alias("vector"),
    )
    row = measured.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("terms"), zero).alias("terms"),
        F.coalesce(
            F.sum(F.col("text_bytes") + (F.col("terms") + 1) * F.col("id_bytes")), zero
        ).alias("text_bytes"),
        F.coalesce(F.sum("vector"), zero).alias("vector_values"),
    ).first()
    return QuerySize(row["rows"], row["terms"], row["text_bytes"], max(row["vector_values"], 0))


def keys_fit(frame: DataFrame, *keys: str, budget: Budget = DEFAULT_BUDGET) -> bool:
    """Whether the key columns of a stored frame, measured now, are small enough to broadcast."""
    width = sum(
        (F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) for key in keys), F.lit(0)
    )
    row = frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(width), F.lit(0).cast("long")).alias("bytes"),
    ).first()
    size = row["bytes"] + row["rows"] * ROW_OVERHEAD
    return row["rows"] <= budget.max_rows and size <= budget.max_bytes


def hinted(frame: DataFrame, fits: bool) -> DataFrame:
    """The frame with a broadcast hint if it was measured to fit, else as it is."""
    return F.broadcast(frame) if fits else frame


def in_tasks(frame: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows dealt over ``tasks`` tasks, by default the shuffle width.

    For work that is heavy per row, such as a model call: rows that are few bytes would
    else be merged into one task. Spark does not merge a stated number of partitions.
    """
    width = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(tasks or width)


def target_rows(rows: DataFrame, least: int = 100_000) -> tuple[int, int]:
    """A task's share of the rows that ``rows(rows)`` counts, at least ``least``, and the tasks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.coalesce(F.sum("rows"), F.lit(0).cast("long"))).first()[0]
    return max(least, -(-total // tasks)), tasks


def lanes_for(frame: DataFrame) -> int:
    """How many lanes to split a hot key into: the square root of the shuffle width."""
    width = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, round(width**0.5))


def lane(key: Column | str, lanes: int) -> Column:
    """A stable lane number in ``[0, lanes)``."""
    return F.pmod(F.xxhash64(key), F.lit(lanes).cast("long")).cast("int")
