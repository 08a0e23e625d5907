"""Dense vector retrieval: exact top-k, and an approximate index over k-means cells.

Scores are dot products, which is cosine similarity on vectors of length one; ingest
normalises vectors. Only the best ``k`` per query leave a task, so no table of all
(query, vector) pairs ever exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekloom.config import DEFAULT_BUDGET, Budget
from seekloom.operators.keyword import attach_text
from seekloom.plans.scratch import scratch_path, written
from seekloom.plans.sizing import ROW_OVERHEAD, QuerySize, measure_queries
from seekloom.plans.topk import by_score, top_k

QUERY_SLICE = 512  # queries scored per matrix product, bounds the score matrix
POOL_ROWS = 1_000_000  # candidates kept before they are cut to k per query again
QUERY_BLOCK = 4_096  # queries that are sent to the corpus together, however small the budget


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a float64 matrix; all rows must have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = dim if dim is not None else (len(values) // rows if rows else 0)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if rows and not (lengths == width).all():
        raise ValueError(f"vectors must all have dimension {width}")
    return values.reshape(rows, width)


class _BestPerQuery:
    """Running best ``k`` (query position, chunk id, score) of one task."""

    def __init__(self, k: int, n_queries: int):
        self.k = k
        self.parts: list[pd.DataFrame] = []
        self.rows = 0
        self.limit = POOL_ROWS
        # Below this score a query has k better chunks already.
        self.floor = np.full(n_queries, -np.inf)

    def add(self, query_rows: np.ndarray, chunk_ids: np.ndarray, scores: np.ndarray) -> None:
        """Take a block of scores (queries x chunks), keeping the best k of each row."""
        k = min(self.k, scores.shape[1])
        if k == 0:
            return
        cut = np.partition(scores, -k, axis=1)[:, -k]
        # Slightly below the k-th score, so that all ties after rounding stay in.
        needed = np.maximum(cut, self.floor[query_rows]) - 1e-8
        at_query, at_chunk = np.nonzero(scores >= needed[:, None])
        self.parts.append(
            pd.DataFrame(
                {
                    "query": query_rows[at_query],
                    "chunk_id": chunk_ids[at_chunk],
                    "score": scores[at_query, at_chunk],
                    "order": np.round(scores[at_query, at_chunk], 8),
                }
            )
        )
        self.rows += len(at_query)
        if self.rows > self.limit:
            self.cut()

    def cut(self) -> pd.DataFrame:
        """Reduce the pool to the best k per query, ties by chunk id."""
        if not self.parts:
            return pd.DataFrame({"query": [], "chunk_id": [], "score": [], "order": []})
        pool = pd.concat(self.parts, ignore_index=True).sort_values(
            ["query", "order", "chunk_id"], ascending=[True, False, True], kind="stable"
        )
        pool = pool.groupby("query", sort=False).head(self.k)
        self.parts, self.rows = [pool], len(pool)
        self.limit = max(POOL_ROWS, 2 * len(pool))
        worst = pool.groupby("query")["score"].agg(["size", "min"])
        full = worst[worst["size"] == self.k]
        self.floor[full.index.to_numpy(dtype=int)] = full["min"].to_numpy()
        return pool


def _score_slices(
    best: _BestPerQuery, query_rows: np.ndarray, queries: np.ndarray, ids, vectors: np.ndarray
) -> None:
    for start in range(0, len(query_rows), QUERY_SLICE):
        part = slice(start, start + QUERY_SLICE)
        best.add(query_rows[part], ids, queries[part] @ vectors.T)


def _hits_schema(queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", T.StringType()),
            T.StructField("search_score", T.DoubleType()),
        ]
    )


def _queries_per_cell(cells: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """The positions of the queries that probe each cell."""
    column = cells.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    positions = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    order = np.argsort(flat, kind="stable")
    values, first = np.unique(flat[order], return_index=True)
    return dict(zip(values.tolist(), np.split(positions[order], first)[1:], strict=True))


def _scan_with_broadcast(
    table: pa.Table, corpus: DataFrame, k: int, schema: T.StructType
) -> DataFrame:
    """Local top-k of every task, with the (bounded) query matrix sent to each executor.

    A column ``cells`` limits a query to the rows of the cells it probes.
    """
    matrix = _matrix(table["query_vector"])
    probing = _queries_per_cell(table["cells"]) if "cells" in table.column_names else None
    shared = corpus.sparkSession.sparkContext.broadcast((table["query_id"], matrix, probing))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix, query_cells = shared.value
        if not len(query_ids):
            return
        best = _BestPerQuery(k, len(query_ids))
        positions = np.arange(len(query_ids))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            vectors = _matrix(batch.column("embedding"), query_matrix.shape[1])
            if query_cells is None:
                _score_slices(best, positions, query_matrix, ids, vectors)
                continue
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            for cell in np.unique(cells).tolist():
                if (asking := query_cells.get(cell)) is not None:
                    rows = cells == cell
                    _score_slices(best, asking, query_matrix[asking], ids[rows], vectors[rows])
        pool = best.cut()
        if len(pool):
            yield pa.RecordBatch.from_arrays(
                [
                    query_ids.take(pa.array(pool["query"].to_numpy(dtype=np.int64)))
                    .combine_chunks(),
                    pa.array(pool["chunk_id"].to_numpy(dtype=object), pa.string()),
                    pa.array(pool["score"].to_numpy(dtype=np.float64)),
                ],
                names=["query_id", "chunk_id", "search_score"],
            )

    return corpus.mapInArrow(search, schema)


def _block_rows(size: QuerySize, budget: Budget, k: int) -> int:
    """How many queries one broadcast may hold; never less than a block that surely fits.

    A task holds the best ``k`` of each, which are to fill half of its pool at most.
    """
    each = max(1, (size.vector_values * 8 + size.text_bytes) // max(1, size.rows) + ROW_OVERHEAD)
    return max(QUERY_BLOCK, min(budget.max_rows, budget.max_bytes // each, POOL_ROWS // (2 * max(1, k))))


def _scan_blocks(
    blocked: DataFrame, count: int, corpus: DataFrame, k: int, schema: T.StructType
) -> DataFrame:
    """Local top-k for query blocks that are sent one after the other to a corpus that stays in place.

    ``blocked`` has the block number of each query in ``_block``. The corpus is read once per
    block, or with ``cells`` only the cells that the block's queries probe; it is never
    exchanged or repeated. Each block's hits are stored before the next one is sent.
    """
    spark = corpus.sparkSession
    path = scratch_path(spark, "query-blocks")
    blocked.write.partitionBy("_block").parquet(path)
    stored = spark.read.schema(blocked.schema).parquet(path)
    hits = scratch_path(spark, "block-hits")
    for block in range(count):
        rows = stored.filter(F.col("_block") == block).drop("_block").toArrow()
        if rows.num_rows:
            local = _scan_with_broadcast(rows, _reached(rows, corpus), k, schema)
            local.write.parquet(f"{hits}/block={block}")
    if not count:
        return spark.createDataFrame([], schema)
    with_block = T.StructType([*schema.fields, T.StructField("block", T.IntegerType())])
    return spark.read.schema(with_block).parquet(hits).drop("block")


def _reached(rows: pa.Table, corpus: DataFrame) -> DataFrame:
    """The part of a cell table that any query probes; a literal list prunes partitions when planning."""
    if "cells" not in rows.column_names:
        return corpus
    cells = np.unique(rows["cells"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
    return corpus.filter(F.col("cell").isin(cells.tolist()))


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    size: QuerySize | None = None,
    budget: Budget = DEFAULT_BUDGET,
) -> DataFrame:
    """Exact nearest ``k``: ``query_id, chunk_id, search_score, rank``.

    ``queries(query_id, query_vector)``, ``corpus(chunk_id, embedding)``. A query table beyond
    the budget is searched for in blocks.
    """
    queries = queries.select("query_id", "query_vector").filter(F.col("query_vector").isNotNull())
    corpus = corpus.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
    size = size or measure_queries(queries)
    held = _block_rows(size, budget, k)
    if size.vectors_fit(budget) and size.rows <= held:
        local = _scan_with_broadcast(queries.toArrow(), corpus, k, _hits_schema(queries))
    else:
        count = -(-size.rows // held)
        block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, count))).cast("int")
        local = _scan_blocks(queries.withColumn("_block", block), count, corpus, k, _hits_schema(queries))
    return top_k(local, ["query_id"], by_score("search_score"), k, spread_by="chunk_id")


def vector_search(
    queries: DataFrame,
    corpus: DataFrame,
    chunks: DataFrame,
    k: int = 10,
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Nearest chunks with their text. Queries need a vector, or a text and ``embed``."""
    if "query_vector" not in queries.columns:
        if "query_text" not in queries.columns or embed is None:
            raise ValueError("queries need query_vector, or query_text and an embed function")
        queries = written(embed(queries), "asked")
    size = measure_queries(queries)
    hits = written(vector_topk(queries, corpus, k, size), "nearest")
    return attach_text(hits, chunks)


def fit_cells(corpus: DataFrame, n_cells: int, seed: int = 7, max_iter: int = 10) -> KMeansModel:
    """Train the cells of the approximate index on all vectors of the corpus."""
    features = corpus.select(array_to_vector("embedding").alias("features"))
    return KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(features)


def assign_cells(embeddings: DataFrame, model: KMeansModel) -> DataFrame:
    """The index rows ``chunk_id, embedding, cell`` of the given vectors."""
    return model.transform(
        embeddings.select("chunk_id", "embedding", array_to_vector("embedding").alias("features"))
    ).select("chunk_id", "embedding", F.col("prediction").alias("cell"))


def refresh_cells(
    index: DataFrame, changed: DataFrame, model: KMeansModel, fits: bool
) -> DataFrame:
    """The approximate index after new or changed vectors; others keep their cell.

    ``changed`` has one row per id and ``fits`` says whether its ids may be broadcast.
    """
    ids = changed.select("chunk_id")
    kept = index.join(F.broadcast(ids) if fits else ids, "chunk_id", "left_anti")
    return kept.unionByName(assign_cells(changed, model))


def vector_topk_approx(
    queries: DataFrame,
    index: DataFrame,
    model: KMeansModel,
    k: int = 10,
    n_probe: int = 4,
    budget: Budget = DEFAULT_BUDGET,
) -> DataFrame:
    """Nearest ``k`` among the chunks in the ``n_probe`` cells closest to each query.

    On a table partitioned by ``cell``, cells that no query of the batch probes are not read.
    The model keeps its centres in one matrix on the driver and in each task; an index of more
    cells than that suits has two levels (:mod:`seekloom.operators.cell_tree`).
    """
    queries = queries.select("query_id", "query_vector").filter(F.col("query_vector").isNotNull())
    centers = np.stack(model.clusterCenters())
    n_probe = min(n_probe, len(centers))
    shared = index.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf("array<int>")
    def nearest_cells(vectors: pd.Series) -> pd.Series:
        matrix = np.stack(vectors.to_numpy()).astype(np.float64)
        order = np.argsort(squared_distances(matrix, shared.value), axis=1, kind="stable")
        return pd.Series(list(order[:, :n_probe].astype(np.int32)))

    return search_cells(queries.withColumn("cells", nearest_cells("query_vector")), index, k, budget)


def squared_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each centre, less the square of the point itself."""
    return (centers**2).sum(axis=1)[None, :] - 2.0 * (points @ centers.T)


def search_cells(
    probed: DataFrame, index: DataFrame, k: int, budget: Budget = DEFAULT_BUDGET
) -> DataFrame:
    """Nearest ``k`` of ``probed(query_id, query_vector, cells)`` in the cells that each query probes.

    Beyond the budget the (query, cell) pairs are put into blocks along the order of the
    cells, so a block's queries probe few cells and a cell is read by one block, or by
    several if more queries than a block holds probe it.
    """
    size = measure_queries(probed)
    held = _block_rows(size, budget, k)
    if size.vectors_fit(budget) and size.rows <= held:
        rows = probed.toArrow()
        local = _scan_with_broadcast(rows, _reached(rows, index), k, _hits_schema(probed))
        return top_k(local, ["query_id"], by_score("search_score"), k, spread_by="chunk_id")
    pairs = written(probed.withColumn("cell", F.explode("cells")).drop("cells"), "probed-pairs")
    # One row per probed cell; the running sum over them gives each cell its place.
    counts = pairs.groupBy(F.col("cell").alias("_cell")).agg(F.count(F.lit(1)).alias("_asking"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_asking").over(before), F.lit(0)))
    place = F.col("_before") + F.pmod(F.xxhash64("query_id"), F.col("_asking"))
    blocked = (
        pairs.join(counts, F.col("cell") == F.col("_cell"))
        .withColumn("_block", F.floor(place / F.lit(held)).cast("int"))
        .groupBy("query_id", "_block")
        .agg(F.first("query_vector").alias("query_vector"), F.collect_list("cell").alias("cells"))
        .select("query_id", "query_vector", "cells", "_block")
    )
    count = -(-pairs.count() // held)
    local = _scan_blocks(blocked, count, index, k, _hits_schema(probed))
    return top_k(local, ["query_id"], by_score("search_score"), k, spread_by="chunk_id")
