"""The join between a large keyed table and a query-side table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekloom.config import DEFAULT_BUDGET
from seekloom.plans.sizing import target_rows


def in_lanes(large: DataFrame, small: DataFrame, rows: DataFrame, key: str, spread_by: str, target: int):
    """Both sides with ``_lane``: as many lanes for a key as its rows fill, of ``target`` each.

    ``rows(key, rows)`` are the known row counts of the keys in ``large``. A light key has one
    lane and its small side stays single; a heavy one is dealt over lanes by ``spread_by`` and
    its small side is repeated once per lane. At most (all rows / target) keys are heavy, so
    with a target of a task's share there are no more of them than tasks.
    """
    heavy = rows.filter(F.col("rows") > target).select(
        F.col(key).alias("_key"), F.ceil(F.col("rows") / F.lit(target)).cast("int").alias("_lanes")
    )
    own = F.coalesce(F.col("_lanes"), F.lit(1))
    spread = large.join(F.broadcast(heavy), F.col(key) == F.col("_key"), "left")
    spread = spread.withColumn("_lane", F.pmod(F.xxhash64(spread_by), own).cast("int"))
    repeated = small.join(F.broadcast(heavy), F.col(key) == F.col("_key"), "left")
    repeated = repeated.withColumn("_lane", F.explode(F.sequence(F.lit(0), own - 1)))
    return spread.drop("_key", "_lanes"), repeated.drop("_key", "_lanes")


def join_by_known_rows(
    large: DataFrame, small: DataFrame, on: list[str], rows: DataFrame, key: str, spread_by: str, fits: bool,
    merge: bool = False,
) -> DataFrame:
    """Inner join of ``large`` with a query-side table when the rows of each key are known.

    When the query side fits it is broadcast and ``large`` does not move. Beyond that only
    heavy keys are spread, each over as many lanes as its rows fill, so a task gets about a
    task's share of rows whatever the key, and light keys are not repeated. With ``merge`` Spark
    may not choose a broadcast either: the stored size of a compressed table says little of its rows.
    """
    if fits:
        return large.join(F.broadcast(small), on, "inner")
    target, tasks = target_rows(rows)
    if tasks > DEFAULT_BUDGET.max_rows:
        raise ValueError("spark.sql.shuffle.partitions exceeds the rows that may be broadcast")
    spread, repeated = in_lanes(large, small, rows, key, spread_by, target)
    if merge:
        repeated = repeated.hint("merge")
    return spread.join(repeated, [*on, "_lane"], "inner").drop("_lane")
