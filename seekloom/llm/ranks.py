"""Exact row numbers over any number of rows, without a window that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekloom.plans.scratch import written

_ROW_BITS = 33  # Spark puts the partition above these bits of monotonically_increasing_id


def ranked(frame: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 1 in ``order``; nulls in ``group`` are a group.

    Rows are dealt out by ranges of (group, order), so a group that holds a third of all
    rows is spread over as many tasks. A row's number is its place in its range plus the
    rows of its group in earlier ranges; the table of earlier counts has a row per range
    and group, and the join back is by (range, group), so no key outgrows a range. The
    sorted rows are stored, so that all readers see the same ranges. Rows that tie in
    ``order`` are numbered arbitrarily among themselves.
    """
    keys = [F.col(column).asc_nulls_last() for column in group] + order
    place = F.monotonically_increasing_id()
    stored = written(
        frame.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", place)
        .withColumn("_range", F.shiftright("_place", _ROW_BITS)),
        "ranked",
    )
    held = stored.groupBy("_range", *group).agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_held")
    )
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("_before", F.coalesce(F.sum("_held").over(earlier), F.lit(0))).select(
        F.col("_range").alias("_of_range"),
        *(F.col(column).alias(f"_of_{column}") for column in group),
        "_first",
        "_before",
    )
    on = stored["_range"] == before["_of_range"]
    for column in group:
        on = on & stored[column].eqNullSafe(before[f"_of_{column}"])
    return stored.join(before, on).select(
        *frame.columns, (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias(name)
    )
