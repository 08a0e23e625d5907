"""Scratch tables in the shared folder that the cluster names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile are deleted when it is written.

    Spark keeps them until the driver happens to collect its garbage, although a written frame
    is read from its files. A frame that is run again all the same makes them anew.
    """
    held = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, True)
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, held)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` stores meanwhile are deleted at the end; nothing may read them later."""
    paths: list[str] = []
    outer = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(outer)
        for path in paths:
            remove_folder(spark, path)


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it back, cutting its lineage at a durable table."""
    path = scratch_path(frame.sparkSession, name)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    with freed_shuffles(frame.sparkSession):
        frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def written_counted(frame: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The same, with the number of rows, which is observed while they are written."""
    seen = Observation()
    stored = written(frame.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return stored, observed_rows(seen, stored)


def observed_rows(seen: Observation, stored: DataFrame) -> int:
    """The rows that were observed; a plan that Spark found to be empty is not observed, but counted."""
    try:
        return seen.get["rows"]
    except Py4JJavaError:
        return stored.count()


def _in_store(spark: SparkSession, path: str):
    """A path and the store that it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder or file of that path, in whatever store it is."""
    target, store = _in_store(spark, path)
    return store.exists(target)


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever store it is, for tables that nothing reads any more.

    Returns whether there was one.
    """
    target, store = _in_store(spark, path)
    return store.delete(target, True)


def forget(*frames: DataFrame) -> None:
    """Delete the folders of frames that ``written`` gave and that nothing reads any more."""
    for frame in frames:
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            remove_folder(frame.sparkSession, folder)
