"""Cells of the approximate index in two levels, for corpora that no single centre matrix covers.

Coarse centres split the corpus; each coarse cell has fine centres of its own, as many as its
vectors fill, so that fine cells stay even although coarse ones are not. Only the coarse
centres are on the driver and in every task. Fine centres are a table: points and the centres
of their coarse cell meet in the tasks of a shuffle by coarse cell, in which a large coarse cell
is dealt over lanes and its centres are repeated per lane.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekloom.config import DEFAULT_BUDGET, Budget
from seekloom.operators.vectors import _matrix, fit_cells, search_cells, squared_distances
from seekloom.plans.joins import in_lanes
from seekloom.plans.scratch import written
from seekloom.plans.sizing import target_rows
from seekloom.plans.topk import top_k

SAMPLE_PER_CELL = 64  # vectors that each fine centre is trained on, chosen by hash
ROUNDS = 12
RANKED_ROWS = 1_024  # vectors compared with the centres together
RANKED_VALUES = 1 << 20  # (vector, cell) rows, or their components, that leave the comparison together
_POINT = "id string, vector array<double>, cell int, distance double"


@dataclass(frozen=True)
class CellTree:
    """Coarse centres and the stored table ``(coarse, cell, center)`` of the fine ones."""

    coarse: KMeansModel
    fine: DataFrame

    @property
    def width(self) -> int:
        """Components of a vector."""
        return len(self.coarse.clusterCenters()[0])


def _near_coarse(points: DataFrame, model: KMeansModel, keep: int) -> DataFrame:
    """``(id, vector, coarse)``: each point with its ``keep`` nearest coarse cells."""
    centers = np.stack(model.clusterCenters())
    shared = points.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        matrix = np.stack(vectors.to_numpy()).astype(np.float64)
        order = np.argsort(squared_distances(matrix, shared.value), axis=1, kind="stable")
        return pd.Series(list(order[:, :keep].astype(np.int32)))

    return points.withColumn("coarse", F.explode(nearest("vector")))


def fit_cell_tree(
    corpus: DataFrame, n_coarse: int, cell_rows: int, seed: int = 7, budget: Budget = DEFAULT_BUDGET
) -> CellTree:
    """Train a tree over ``corpus(chunk_id, embedding)`` with fine cells of about ``cell_rows`` vectors.

    The coarse centres see all vectors; the fine centres of a coarse cell a sample of
    ``SAMPLE_PER_CELL`` vectors for each. A coarse cell has as many fine cells as its rows ask
    for, as long as their centres fit the budget of one task.
    """
    corpus = corpus.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
    model = fit_cells(corpus, n_coarse, seed)
    points = corpus.select(F.col("chunk_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    points = written(_near_coarse(points, model, 1), "coarse-points")
    width = len(model.clusterCenters()[0])
    most = max(1, budget.max_bytes // (8 * width * SAMPLE_PER_CELL))
    # At most one row per coarse centre, of which the driver holds all.
    sizes = {row["coarse"]: row["count"] for row in points.groupBy("coarse").count().collect()}
    layout, first = [], 0
    for coarse, rows in sorted(sizes.items()):
        cells = min(most, max(1, round(rows / cell_rows)))
        layout.append((coarse, first, cells, min(1.0, cells * SAMPLE_PER_CELL / rows)))
        first += cells
    plan = points.sparkSession.createDataFrame(layout, "_coarse int, first int, cells int, share double")
    chosen = points.join(F.broadcast(plan), F.col("coarse") == F.col("_coarse"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.ceil(F.col("share") * 1_000_003)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(rows["vector"].to_numpy())[np.argsort(rows["id"].to_numpy(), kind="stable")]
        found = _centers(vectors, int(rows["cells"].iloc[0]), seed)
        return pd.DataFrame(
            {
                "coarse": rows["coarse"].iloc[0],
                "cell": np.arange(len(found)) + int(rows["first"].iloc[0]),
                "center": list(found),
            }
        )

    fine = chosen.filter(drawn).groupBy("coarse").applyInPandas(
        train, "coarse int, cell int, center array<double>"
    )
    return CellTree(model, written(fine, "fine-centers"))


def _centers(vectors: np.ndarray, count: int, seed: int) -> np.ndarray:
    """k-means centres of a bounded sample, at most one per different vector."""
    different = np.unique(vectors, axis=0)
    count = min(count, len(different))
    centers = different[np.random.default_rng(seed).choice(len(different), count, replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate(
            [
                squared_distances(vectors[at : at + RANKED_ROWS], centers).argmin(axis=1)
                for at in range(0, len(vectors), RANKED_ROWS)
            ]
        )
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, vectors)
        held = np.bincount(nearest, minlength=count)
        full = held > 0
        centers[full] = sums[full] / held[full, None]
    return centers


def _near_fine(points: DataFrame, tree: CellTree, keep: int, with_vector: bool = True) -> DataFrame:
    """``(id, vector, cell, distance)``: the ``keep`` nearest fine cells of each ``(id, vector, coarse)``.

    Without ``with_vector`` the vector is null, so that it is not repeated for each of the cells.
    """
    points = written(points, "coarse-points")
    counts = points.groupBy("coarse").agg(F.count(F.lit(1)).alias("rows"))
    target, tasks = target_rows(counts)
    centers = tree.fine.select("coarse", F.col("center").alias("vector"), "cell")
    spread, repeated = in_lanes(points, centers, counts, "coarse", "id", target)
    nothing = F.lit(None)
    rows = repeated.select("coarse", "_lane", F.lit(0).alias("kind"), nothing.cast("string").alias("id"), "vector", "cell")
    rows = rows.unionByName(
        spread.select("coarse", "_lane", F.lit(1).alias("kind"), "id", "vector", nothing.cast("int").alias("cell"))
    )
    # The centres of a coarse cell come before its points.
    dealt = rows.repartition(tasks, "coarse", "_lane").sortWithinPartitions("coarse", "_lane", "kind")
    width = tree.width

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centers, cells = None, np.empty((0, width)), np.empty(0, dtype=np.int32)
        for batch in batches:
            keys = np.stack([batch.column(at).to_numpy(zero_copy_only=False) for at in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                group, kind = tuple(keys[low, :2]), keys[low, 2]
                part = batch.slice(low, high - low)
                vectors = _matrix(part.column("vector"), width)
                if kind == 0:
                    numbers = part.column("cell").to_numpy(zero_copy_only=False).astype(np.int32)
                    if group != now:
                        now, centers, cells = group, vectors, numbers
                    else:
                        centers, cells = np.vstack([centers, vectors]), np.append(cells, numbers)
                elif group == now:
                    yield from _ranked(part, vectors, centers, cells, keep, with_vector)

    return dealt.mapInArrow(nearest, _POINT)


def _ranked(
    part: pa.RecordBatch,
    vectors: np.ndarray,
    centers: np.ndarray,
    cells: np.ndarray,
    keep: int,
    with_vector: bool,
) -> Iterator[pa.RecordBatch]:
    each = max(1, min(keep, len(cells))) * (vectors.shape[1] if with_vector else 1)
    step = max(1, min(RANKED_ROWS, RANKED_VALUES // each))
    for start in range(0, len(vectors), step):
        some = vectors[start : start + step]
        distance = squared_distances(some, centers)
        order = np.argsort(distance, axis=1, kind="stable")[:, :keep]
        rows = pa.array(np.repeat(np.arange(start, start + len(some)), order.shape[1]))
        column = part.column("vector")
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id").take(rows),
                column.take(rows) if with_vector else pa.nulls(len(rows), column.type),
                pa.array(cells[order].ravel(), pa.int32()),
                pa.array(np.take_along_axis(distance, order, axis=1).ravel()),
            ],
            names=["id", "vector", "cell", "distance"],
        )


def assign_tree_cells(embeddings: DataFrame, tree: CellTree) -> DataFrame:
    """The index rows ``chunk_id, embedding, cell`` of the given vectors; those without a vector go."""
    points = embeddings.filter(F.col("embedding").isNotNull()).select(
        F.col("chunk_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    found = _near_fine(_near_coarse(points, tree.coarse, 1), tree, 1)
    return found.select(
        F.col("id").alias("chunk_id"), F.col("vector").cast("array<float>").alias("embedding"), "cell"
    )


def probed_cells(queries: DataFrame, tree: CellTree, n_probe: int, n_coarse: int) -> DataFrame:
    """``(query_id, query_vector, cells)``: the nearest fine cells among those of the nearest coarse cells."""
    queries = queries.select("query_id", "query_vector").filter(F.col("query_vector").isNotNull())
    points = queries.select(
        F.col("query_id").cast("string").alias("id"), F.col("query_vector").cast("array<double>").alias("vector")
    )
    near = _near_fine(_near_coarse(points, tree.coarse, n_coarse), tree, n_probe, with_vector=False)
    near = near.select(F.col("id").alias("_id"), "cell", "distance")
    best = top_k(near, ["_id"], [F.col("distance").asc(), F.col("cell").asc()], n_probe, "cell", "_rank")
    cells = best.groupBy("_id").agg(F.collect_list("cell").alias("cells"))
    return queries.join(cells, F.col("query_id").cast("string") == F.col("_id")).drop("_id")


def vector_topk_tree(
    queries: DataFrame,
    index: DataFrame,
    tree: CellTree,
    k: int = 10,
    n_probe: int = 8,
    n_coarse: int = 4,
    budget: Budget = DEFAULT_BUDGET,
) -> DataFrame:
    """Nearest ``k`` in the ``n_probe`` fine cells next to each query: ``query_id, chunk_id, search_score, rank``.

    Fine cells are looked for in the ``n_coarse`` nearest coarse cells. On a table partitioned
    by ``cell``, only the cells that are probed are read.
    """
    probed = written(probed_cells(queries, tree, n_probe, n_coarse), "probed")
    return search_cells(probed, index, k, budget)
