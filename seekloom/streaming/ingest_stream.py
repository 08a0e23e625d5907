"""Ingest as streams of chunk files and of vector shards.

``available_now=True`` processes what has arrived and stops; otherwise the streams run
and follow their directories. A micro-batch that is repeated after a failure leaves the
same rows, because an ingest replaces by chunk id.

Chunks and vectors need not arrive together. Each is stored when it comes, and the one that
comes second finds the other by its id in the lake: the batch's ids are joined with both
stored tables, so ``wide`` and ``cells`` get a row once both halves are there, in either order.
The lake has one writer at a time, so micro-batches of the two streams take turns.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from seekloom.config import IDS_FILE, LakeConfig
from seekloom.plans.ingest import ingest
from seekloom.schemas import CHUNK
from seekloom.sources.shards import shard_vectors

_turn = threading.Lock()  # streams of one application take turns on a lake

_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _follow(
    arriving: DataFrame,
    take: Callable[[DataFrame], None],
    checkpoint: str,
    available_now: bool,
    interval: str,
) -> StreamingQuery:
    def in_turn(batch: DataFrame, _batch_id: int) -> None:
        with _turn:
            take(batch)

    writer = arriving.writeStream.foreachBatch(in_turn).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def start_ingest_stream(
    spark: SparkSession,
    directory: str,
    lake: LakeConfig,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "1 minute",
    max_files: int = 1000,
    cell_model: KMeansModel | None = None,
) -> StreamingQuery:
    """Start ingesting JSON-lines chunk files that appear in ``directory``.

    ``cell_model`` assigns cells from the first batch on; later it is stored with the lake.
    """
    arriving = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", max_files).json(directory)
    return _follow(
        arriving,
        lambda batch: ingest(batch.sparkSession, lake, batch, cell_model=cell_model),
        checkpoint,
        available_now,
        interval,
    )


def start_vector_stream(
    spark: SparkSession,
    directory: str,
    model_name: str,
    lake: LakeConfig,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "1 minute",
    max_files: int = 1000,
    on_mismatch: str = "fail",
) -> StreamingQuery:
    """Start ingesting vector shards whose id list appears in ``{directory}/{model_name}/<shard>/``.

    The stream follows the id lists, so a shard's matrix is to be written before its ids.
    Only the paths go through the stream; a batch reads its shards in row ranges. Chunks and
    their index are left as they are.
    """
    base = directory if directory.endswith("/") else directory + "/"
    paths = (
        spark.readStream.schema(_FILE)
        .format("binaryFile")
        .option("maxFilesPerTrigger", max_files)
        .load(f"{base}{model_name}/*/{IDS_FILE}")
        .select("path")
    )

    def take(batch: DataFrame) -> None:
        session = batch.sparkSession
        folders = batch.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
        vectors = shard_vectors(session, folders, on_mismatch)
        ingest(session, lake, session.createDataFrame([], CHUNK), vectors)

    return _follow(paths, take, checkpoint, available_now, interval)
