"""Exact top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekloom.plans.sizing import lane, lanes_for


def top_k(
    frame: DataFrame,
    group: list[str],
    order: list[Column],
    k: int,
    spread_by: str,
    rank: str = "rank",
    lanes: int | None = None,
) -> DataFrame:
    """Keep the first ``k`` rows of each group and number them in ``rank``.

    Spark cuts each map partition to ``k`` rows per group before the exchange. With
    thousands of map partitions one group would still receive ``k`` rows from each, so
    on wide shuffles the cut is made per (group, lane) first and then per group.
    """
    lanes = lanes_for(frame) if lanes is None else lanes
    if lanes > 1:
        by_lane = Window.partitionBy(*group, "_lane").orderBy(*order)
        frame = (
            frame.withColumn("_lane", lane(spread_by, lanes))
            .withColumn("_lane_rank", F.row_number().over(by_lane))
            .filter(F.col("_lane_rank") <= k)
            .drop("_lane", "_lane_rank")
        )
    by_group = Window.partitionBy(*group).orderBy(*order)
    return frame.withColumn(rank, F.row_number().over(by_group)).filter(F.col(rank) <= k)


def by_score(score: str, tie: str = "chunk_id") -> list[Column]:
    """Descending score rounded to 8 digits, ties by id, so that ranks are repeatable."""
    return [F.round(F.col(score), 8).desc(), F.col(tie).asc()]
