"""Connected components of a table of links, as a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekloom.plans.scratch import written

MAX_ROUNDS = 64


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` for each node of a link; the component is its smallest node.

    Links are hooked round by round. In a round each node points its larger neighbours
    to its smallest one, then its smaller ones, until the links form stars. A node's
    smallest neighbour is a partial aggregate and goes back to its links by a join that
    Spark may split, so a node with very many links needs no task of its own. Each round
    is stored, which cuts the lineage; only two sums come to the driver. Self-links,
    repeated links and nulls are allowed; no links give no rows.
    """
    edges = links.select(
        F.greatest(left, right).alias("a"), F.least(left, right).alias("b")
    ).filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") != F.col("b")))
    edges = written(edges.distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        # Larger neighbours point to the smallest neighbour (or the node itself).
        near = _both(edges)
        low = near.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        low = low.select("n", F.least("n", "m").alias("m"))
        large = near.filter("b > a").join(low, F.col("a") == F.col("n")).select(
            F.col("b").alias("a"), F.col("m").alias("b")
        )
        large = large.filter("a != b").distinct()
        # Smaller neighbours and the node itself point to the smallest one.
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        own = low.select(F.col("n").alias("a"), F.col("m").alias("b"))
        rest = large.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(own.unionByName(rest.filter("a != b")).distinct(), "links")
        sums = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (sums["n"], sums["h"]) == state:
            break
        state = (sums["n"], sums["h"])
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)
