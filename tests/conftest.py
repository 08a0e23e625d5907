"""A local Spark session shared by all tests."""

from __future__ import annotations

import contextlib
import io
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """Spark on four local threads."""
    session = (
        SparkSession.builder.master("local[4]")
        .appName("seekloom-tests")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.seekloom.scan.tasks", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def plan_text():
    """The physical plan of a frame as text."""

    def text(frame) -> str:
        buffer = io.StringIO()
        with contextlib.redirect_stdout(buffer):
            frame.explain("formatted")
        return buffer.getvalue()

    return text


CHUNK_SCHEMA = "chunk_id string, source_file string, chunk_index_in_file long, text string"


@pytest.fixture(scope="session")
def make_chunks(spark):
    """Chunks from ``{id: text}``; every chunk is in file ``/d/<id>.txt``."""

    def make(texts: dict):
        rows = [(key, f"/d/{key}.txt", 0, text) for key, text in texts.items()]
        return spark.createDataFrame(rows, CHUNK_SCHEMA)

    return make


@pytest.fixture(scope="session")
def make_queries(spark):
    """Queries from a list of texts, numbered from 1."""

    def make(*texts):
        return spark.createDataFrame(
            list(enumerate(texts, start=1)), "query_id long, query_text string"
        )

    return make
