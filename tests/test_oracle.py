"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

import importlib

import pytest

from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
entry_module = importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def duck():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_matches_sql(spark, duck, name):
    frame = entry_module.queries()[name](spark, SF_DIR)
    assert differences(frame, duck, entry_module.oracle_sql()[name]) == ""


@pytest.mark.parametrize(
    "name", sorted(set(entry_module.queries()) - set(entry_module.oracle_sql()))
)
def test_has_rows(spark, name):
    assert entry_module.queries()[name](spark, SF_DIR).count() > 0


def test_every_statement_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
