"""Exact copies of texts: found by narrow keys, so that later work runs on one row of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekloom.plans.scratch import written
from seekloom.plans.sizing import hinted, keys_fit


def text_key(text: str = "text") -> Column:
    """A 64-bit key of a text."""
    return F.xxhash64(text)


def find_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, rep)`` of rows whose text a row with a smaller id has too.

    Texts are compared by two hashes and their length. Groups are partial aggregates, so
    the copies of one text meet as sums. Null ids and null texts are left out.
    """
    keyed = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_key"),
        F.hash("text").alias("_other"),
        F.octet_length("text").alias("_length"),
    )
    groups = keyed.groupBy("text_key", "_other", "_length").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("_last")
    )
    groups = groups.filter(F.col("rep") != F.col("_last")).drop("_last")
    found = keyed.join(groups, ["text_key", "_other", "_length"]).filter("doc_id != rep")
    return written(found.select("doc_id", "text_key", "rep").distinct(), "copies")


def without_copies(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """``(doc_id, text_key, text)`` of one row of each text with a word or other character.

    The copies are broadcast if they were measured to fit; beyond that the join shuffles.
    """
    keyed = docs.filter(F.col("doc_id").isNotNull() & (F.col("text") != "")).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text"
    )
    drop = copies.select("doc_id", "text_key")
    fits = keys_fit(drop, "doc_id", "text_key")
    return keyed.join(hinted(drop, fits), ["doc_id", "text_key"], "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in the stored frame ``ids``."""
    ids = ids.select("doc_id")
    return docs.join(hinted(ids, keys_fit(ids, "doc_id")), ["doc_id"], "left_semi")
