"""Keyword search against a plain implementation, and its edge cases."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seekloom.config import Budget, KeywordConfig
from seekloom.operators import keyword
from seekloom.operators.bm25_index import build_index, write_index
from seekloom.operators.lexicon import BOOST_RULES, TERM_WEIGHTS, Lexicon
from seekloom.operators.terms import known_terms, select_terms, weighted_terms
from seekloom.plans.joins import in_lanes
from seekloom.plans.sizing import QuerySize, measure_queries, target_rows
from seekloom.sources.chunks import stored_chunks
from tests.test_analyzer import plain_tokens

LOOSE = KeywordConfig(df_ratio_max=1.0, english_ratio_min=None)


@pytest.fixture(scope="module")
def lexicon(spark):
    return Lexicon.from_terms(spark)


def plain_boost(terms, term):
    factor = 1.1
    for rule in BOOST_RULES:
        if set(terms) & set(rule.triggers) and term in rule.boosted:
            factor = max(factor, rule.factor)
    return factor


def plain_search(texts, queries, config):
    """BM25 by definition over small inputs: {query: [(chunk, score)]}."""
    counts = {key: Counter(plain_tokens(text)) for key, text in texts.items()}
    counts = {key: value for key, value in counts.items() if value}
    n, avgdl = len(counts), sum(sum(c.values()) for c in counts.values()) / len(counts)
    df = Counter(term for c in counts.values() for term in c)
    results = {}
    for number, query in enumerate(queries, start=1):
        terms = list(dict.fromkeys("".join(
            ch if ch.isascii() and ch.isalnum() else " " for ch in query.lower()).split()))
        known = [t for t in terms if t in df]
        kept = [
            t for t in known
            if (t in TERM_WEIGHTS and t != "texas") or df[t] / n <= config.df_ratio_max
        ]
        kept = known if len(kept) < config.min_terms else kept
        scores, hits = defaultdict(float), Counter()
        for key, c in counts.items():
            for t in kept:
                if c[t]:
                    idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)
                    part = idf * c[t] * 2.2 / (
                        c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avgdl)
                    )
                    scores[key] += part * TERM_WEIGHTS.get(t, 0.5) * plain_boost(terms, t)
                    hits[key] += 1
        found = [(k, s) for k, s in scores.items() if hits[k] >= config.min_terms]
        results[number] = sorted(found, key=lambda p: (-round(p[1], 8), p[0]))[: config.k]
    return results


def random_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["flood", "fema", "county", "river", "texas", "model", "alpha", "beta", "gamma", "delta"]
    return {f"c{i}": " ".join(rng.choices(words, k=rng.randint(1, 12))) for i in range(n)}


QUERIES = ("FEMA flood model in Texas county", "alpha beta river", "gamma", "nothing known here")


@pytest.mark.parametrize("config", [LOOSE, KeywordConfig(df_ratio_max=0.3, english_ratio_min=None, k=7)])
def test_matches_plain_bm25(spark, make_chunks, make_queries, lexicon, config):
    texts = random_texts(60)
    chunks = make_chunks(texts)
    found = keyword.keyword_search(
        make_queries(*QUERIES), build_index(chunks), chunks, lexicon, config
    ).collect()
    expected = plain_search(texts, QUERIES, config)
    for number, hits in expected.items():
        rows = sorted((r for r in found if r.query_id == number), key=lambda r: r["rank"])
        assert [r.chunk_id for r in rows] == [key for key, _ in hits]
        assert [r.score for r in rows] == pytest.approx([score for _, score in hits])


def test_shuffle_path_and_lanes_give_the_same_rows(spark, make_chunks, make_queries, lexicon):
    chunks = make_chunks(random_texts(80, seed=5))
    queries = make_queries(*QUERIES)
    index = write_index(chunks, chunk_buckets=2, term_buckets=2)
    small = measure_queries(queries)
    huge = QuerySize(10**9, 10**9, 10**12, 0)
    assert small.terms_fit() and not huge.terms_fit()

    def run(size):
        rows = keyword.keyword_search(queries, index, chunks, lexicon, LOOSE, size).collect()
        return sorted((r.query_id, r["rank"], r.chunk_id, r.matched_terms, round(r.score, 9)) for r in rows)

    expected = run(small)
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "81")
    try:
        assert run(huge) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_one_term_and_empty_queries_have_no_rows_at_defaults(spark, make_chunks, make_queries, lexicon):
    chunks = make_chunks({"a": "flood map", "b": "flood river"})
    queries = make_queries("flood", "", None, "unknown words")
    found = keyword.keyword_search(queries, build_index(chunks), chunks, lexicon)
    assert found.count() == 0
    single = KeywordConfig(min_terms=1)
    rows = keyword.keyword_search(queries, build_index(chunks), chunks, lexicon, single).collect()
    assert {r.chunk_id for r in rows} == {"a", "b"}


def test_fallback_uses_all_known_terms(spark, make_chunks, make_queries, lexicon):
    chunks = make_chunks({f"c{i}": "alpha beta" for i in range(4)})
    kept = select_terms(make_queries("alpha beta zeta"), build_index(chunks), lexicon).collect()
    assert {r.term for r in kept} == {"alpha", "beta"}
    assert all(r.used_fallback for r in kept)


def test_language_filter_after_the_candidate_cut_on_request(spark, make_chunks, make_queries, lexicon):
    foreign = "flood flood flood river river " + "日" * 400
    chunks = make_chunks({"x": foreign, "a": "flood river aaa bbb", "b": "map"})
    config = KeywordConfig(k=1, oversample=1, df_ratio_max=1.0, filter_first=False)
    queries, index = make_queries("flood river"), build_index(chunks)
    shown = keyword.keyword_search(queries, index, chunks, lexicon, config).collect()
    longer = KeywordConfig(k=1, oversample=2, df_ratio_max=1.0, filter_first=False)
    for table in (chunks, stored_chunks(chunks)):
        rows = keyword.keyword_search(queries, index, table, lexicon, longer).collect()
        assert [r.chunk_id for r in rows] == ["a"]
    top = keyword.keyword_search(
        queries, index, chunks, lexicon, KeywordConfig(k=1, df_ratio_max=1.0, english_ratio_min=None)
    ).first()
    assert len(shown) == (0 if top.chunk_id == "x" else 1)


def test_filter_first_keeps_k_rows(spark, make_chunks, make_queries, lexicon):
    foreign = "flood flood flood river river " + "日" * 400
    chunks = make_chunks({"x": foreign, "a": "flood river aaa bbb", "b": "map"})
    queries, index = make_queries("flood river"), build_index(chunks)
    for table in (chunks, stored_chunks(chunks)):
        config = KeywordConfig(k=1, oversample=1, df_ratio_max=1.0)
        rows = keyword.keyword_search(queries, index, table, lexicon, config).collect()
        assert [r.chunk_id for r in rows] == ["a"]


def test_hits_without_a_chunk(spark, make_chunks, make_queries, lexicon):
    index = build_index(make_chunks({"a": "flood river", "b": "flood river map"}))
    only_a = make_chunks({"a": "flood river"})
    queries = make_queries("flood river")
    kept = keyword.keyword_search(queries, index, only_a, lexicon, LOOSE).collect()
    assert {r.chunk_id: r.text for r in kept} == {"a": "flood river", "b": None}
    filtered = KeywordConfig(df_ratio_max=1.0)
    dropped = keyword.keyword_search(queries, index, only_a, lexicon, filtered).collect()
    assert [r.chunk_id for r in dropped] == ["a"]


def test_ties_go_by_id_and_matched_terms_by_score(spark, make_chunks, make_queries, lexicon):
    chunks = make_chunks({"b": "fema alpha beta", "a": "fema alpha beta", "c": "zzz"})
    rows = keyword.keyword_search(
        make_queries("beta alpha fema"), build_index(chunks), chunks, lexicon, LOOSE
    ).collect()
    assert [(r["rank"], r.chunk_id) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, "a"), (2, "b")]
    assert rows[0].matched_terms == ["fema(1)", "alpha(1)", "beta(1)"]


def test_weights_and_boosts(spark, make_queries, lexicon):
    rows = weighted_terms(make_queries("FEMA flood loss in Texas xyz"), lexicon).collect()
    found = {r.term: (r.whitelisted, r.static_weight, r.boost) for r in rows}
    assert found["fema"] == (True, 3.0, 1.5)
    assert found["flood"] == (True, 2.5, 1.4)
    assert found["texas"] == (False, 2.0, 1.3)
    assert found["xyz"] == (False, 0.5, 1.1)


def test_lexicon_size():
    assert len(TERM_WEIGHTS) == 83


def test_plan_has_no_cartesian_product_and_limits_early(
    make_chunks, make_queries, lexicon, plan_text
):
    chunks = stored_chunks(make_chunks(random_texts(20)))
    queries = make_queries(*QUERIES)
    index = write_index(chunks, chunk_buckets=2, term_buckets=2)
    size = measure_queries(queries)
    kept = select_terms(queries, index, lexicon, LOOSE, size)
    ranked = keyword.keyword_ranking(kept, index, KeywordConfig(), size, 5)
    late = keyword.keyword_ranking(kept, index, KeywordConfig(filter_first=False), size, 5)
    found = keyword.candidates(kept, index, 5, KeywordConfig(), size)
    for frame in (ranked, late, found):
        plan = plan_text(frame)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        # One scan of the postings, of the lexicon's and the query side's tables; none of the chunks.
        assert plan.count("/postings]") == 1 and "source_file" not in plan
        assert "term_bucket" in pruned(plan)
    assert "GreaterThanOrEqual(english_ratio" in plan_text(ranked)
    assert "GreaterThanOrEqual(english_ratio" not in plan_text(late)
    assert "WindowGroupLimit" in plan_text(found)
    assert "term_bucket" in pruned(plan_text(kept))


def test_stored_and_computed_ratios_filter_alike(spark, make_chunks, make_queries, lexicon):
    texts = random_texts(40, seed=9)
    for number, key in enumerate(list(texts)):
        texts[key] += " 日本 12 ..." * (number % 7)
    chunks, queries = make_chunks(texts), make_queries(*QUERIES)
    config = KeywordConfig(df_ratio_max=1.0, english_ratio_min=0.75, k=6)
    ratio = {k: sum(c in "abcdefghijklmnopqrstuvwxyz" for c in t.lower()) / len(t) for k, t in texts.items()}
    plain = plain_search(texts, QUERIES, KeywordConfig(df_ratio_max=1.0, english_ratio_min=None, k=10**6))
    want = {n: [k for k, _ in hits if ratio[k] >= 0.75][:6] for n, hits in plain.items()}
    for table in (chunks, stored_chunks(chunks)):
        rows = keyword.keyword_search(queries, build_index(table), table, lexicon, config).collect()
        got = {n: [r.chunk_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == n] for n in want}
        assert got == want
        assert all(len(r.matched_terms) <= config.top_terms for r in rows)


def pruned(plan):
    """The partition filters that are filled in at run time."""
    return " ".join(line for line in plan.splitlines() if "dynamicpruningexpression" in line)


def test_budget_is_respected():
    size = QuerySize(10, 100, 1000, 640)
    assert size.terms_fit(Budget(100, 10_000)) and not size.terms_fit(Budget(99, 10_000))
    assert not size.vectors_fit(Budget(100, 100))


def test_only_heavy_terms_are_dealt_over_lanes(spark, make_chunks):
    """A term of every chunk fills lanes of the target; no other term is repeated."""
    texts = {f"c{i}": f"common word{i % 50} rare{i}" for i in range(2000)}
    index = build_index(make_chunks(texts))
    known = index.df.select("term", F.col("df").alias("rows"))
    side = index.df.select(F.lit(1).alias("query_id"), "term")
    spread, repeated = in_lanes(index.postings, side, known, "term", "chunk_id", 100)
    loads = {(r["term"], r["_lane"]): r["count"] for r in spread.groupBy("term", "_lane").count().collect()}
    lanes = {r["term"]: r["count"] for r in repeated.groupBy("term").count().collect()}
    assert lanes["common"] == 20 and all(n == 1 for term, n in lanes.items() if term != "common")
    assert max(loads.values()) <= 200 and len([1 for term, _ in loads if term == "common"]) == 20
    joined = spread.join(repeated, ["term", "_lane"])
    assert joined.count() == 6000 == index.postings.count()
    assert target_rows(known, 1) == (1500, 4) and target_rows(known)[0] == 100_000


def test_frequencies_are_not_broadcast_to_a_large_query_table(spark, make_chunks, plan_text):
    texts = {str(n): " ".join(f"word{n * 40 + i}" for i in range(40)) + " common" for n in range(50)}
    index = write_index(make_chunks(texts), chunk_buckets=2, term_buckets=2)
    asked = [f"common word{n * 7}" for n in range(30)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")
    lexicon = Lexicon.from_terms(spark)
    known = known_terms(queries, index, lexicon, QuerySize(10**9, 10**9, 10**12, 0))
    lines = plan_text(known).splitlines()
    broadcast = [lines[at + 1] for at, line in enumerate(lines) if line.startswith("(") and "BroadcastExchange" in line]
    assert broadcast and not [line for line in broadcast if "df#" in line]
    few = known_terms(queries, index, lexicon, measure_queries(queries))
    wanted = sorted(few.select("query_id", "term", "df").collect())
    assert sorted(known.select("query_id", "term", "df").collect()) == wanted and len(wanted) == 60
