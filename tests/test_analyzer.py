"""Analyzer and text expressions on the awkward inputs."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekloom.functions.analyzer import document_tokens, query_tokens
from seekloom.functions.text import basename, clean_text, english_ratio
from seekloom.functions.vectors import l2_normalize
from seekloom.operators.bm25_index import build_index, doc_stats_from_postings

AWKWARD = {
    "caps": "Hurricane Harvey FEMA flooded 2017 homes é",
    "none": None,
    "empty": "",
    "digits": "2017 42",
    "short": "tx",
    "mixed": "a1b 12ab 1234 ab_cde ÉCOLE naïve x9",
}


def plain_tokens(text):
    """The definition, step by step: fold, split, drop short and all-digit tokens."""
    parts = re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split()
    return [t for t in parts if len(t) >= 3 and not t.isdigit()]


def one(spark, text, expression):
    frame = spark.createDataFrame([(text,)], "text string")
    return frame.select(expression(F.col("text")).alias("v")).first()["v"]


def test_capitals_are_folded_first(spark):
    assert one(spark, AWKWARD["caps"], document_tokens) == [
        "hurricane", "harvey", "fema", "flooded", "homes",
    ]


def test_capitals_split_words_in_the_other_order(spark):
    found = one(spark, AWKWARD["caps"], lambda c: document_tokens(c, lower_first=False))
    assert found == ["urricane", "arvey", "flooded", "homes"]


@pytest.mark.parametrize("name", AWKWARD)
def test_document_tokens_by_definition(spark, name):
    assert (one(spark, AWKWARD[name], document_tokens) or []) == plain_tokens(AWKWARD[name])


def test_query_tokens_keep_short_and_numeric_once_in_order(spark):
    assert one(spark, "TX flood 2017, tx Flood?", query_tokens) == ["tx", "flood", "2017"]
    assert one(spark, None, query_tokens) == []
    assert one(spark, "", query_tokens) == []


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.text(alphabet="abcXY12 é-", max_size=40), min_size=1, max_size=12))
def test_index_counts_match_a_plain_count(spark, make_chunks, texts):
    chunks = make_chunks({f"c{i}": text for i, text in enumerate(texts)})
    expected = {
        (term, f"c{i}"): (n, len(plain_tokens(text)))
        for i, text in enumerate(texts)
        for term, n in Counter(plain_tokens(text)).items()
    }
    index = build_index(chunks)
    rows = index.postings.collect()
    assert {(r.term, r.chunk_id): (r.tf, r.doc_len) for r in rows} == expected
    assert len(rows) == len(expected)
    lengths = {r.chunk_id: r.doc_len for r in index.doc_stats.collect()}
    assert lengths == {r.chunk_id: r.doc_len for r in doc_stats_from_postings(index.postings).collect()}


def test_postings_do_not_shuffle(make_chunks, plan_text):
    assert "Exchange" not in plan_text(build_index(make_chunks(AWKWARD)).postings)


def test_english_ratio(spark):
    assert one(spark, None, english_ratio) == 0.0
    assert one(spark, "", english_ratio) == 0.0
    assert one(spark, "ABcd 日本", english_ratio) == pytest.approx(4 / 7)


def test_clean_text_replaces_bullets_after_collapsing(spark):
    assert one(spark, " a •  b\n\tc·· ", clean_text) == "a   b c"


def test_basename(spark):
    assert one(spark, "/x/y/z.txt", basename) == "z.txt"
    assert one(spark, "plain", basename) == "plain"


def test_l2_normalize(spark):
    frame = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    found = [r[0] for r in frame.select(l2_normalize("v")).collect()]
    assert found[0] == pytest.approx([0.6, 0.8])
    assert found[1] == [0.0, 0.0]


def test_long_digit_run_is_walked_once(spark):
    import time

    from pyspark.sql import functions as F

    from seekloom.functions.analyzer import document_tokens

    text = "1" * 1_000_000 + " flood " + "2" * 500_000 + "a9"
    frame = spark.createDataFrame([(text,)], "text string")
    counted = frame.select(F.size(document_tokens("text")).alias("n"))
    counted.first()
    start = time.time()
    assert counted.first()["n"] == 2
    assert time.time() - start < 5
