"""SQL counterparts of the registered queries, over the bundled tables.

Each statement is put together from named table expressions; a statement states only
what it selects, and the expressions it needs are found through their dependencies.
"""

from __future__ import annotations

import re

from seekloom.operators.lexicon import NOT_WHITELISTED, TERM_WEIGHTS
from seekloom.operators.prompts import SYSTEM_PROMPT, USER_HEADINGS
from seekloom.workload.inputs import LEXICON_RATIO, LEXICON_WEIGHT, RULES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(row) + ")" for row in rows)


def _tokens_of(source: str, text: str) -> str:
    split = f"unnest(string_split_regex({text}, '\\s+'))"
    return f"""SELECT chunk_id, term FROM (SELECT chunk_id, {split} AS term FROM {source})
        WHERE length(term) >= 3 AND NOT regexp_full_match(term, '[0-9]+')"""


def _folded(text: str = "text") -> str:
    return f"regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')"


def _index(prefix: str, source: str, text: str = _folded()) -> dict[str, str]:
    """Postings, lengths, frequencies and meta of one chunk table."""
    return {
        f"{prefix}tok": _tokens_of(source, text),
        f"{prefix}post": f"SELECT term, chunk_id, cast(count(*) AS integer) AS tf "
        f"FROM {prefix}tok GROUP BY term, chunk_id",
        f"{prefix}stats": f"SELECT chunk_id, cast(sum(tf) AS integer) AS doc_len "
        f"FROM {prefix}post GROUP BY chunk_id",
        f"{prefix}freq": f"SELECT term, count(*) AS df FROM {prefix}post GROUP BY term",
        f"{prefix}meta": f'SELECT count(*) AS "N", avg(doc_len) AS avgdl FROM {prefix}stats',
    }


def _keyword(prefix: str, pool: int | None, k: int, ratio: float) -> dict[str, str]:
    """Language filter and final cut of a keyword search, after a cut to ``pool`` if there is one."""
    cut = f"WHERE rank <= {pool}" if pool else ""
    return {
        f"{prefix}cand": f"""SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, chunk_id) AS integer) AS rank
            FROM chunk_score) {cut}""",
        f"{prefix}kw": f"""SELECT * FROM (SELECT query_id, chunk_id, score, text, source_file,
            chunk_index_in_file, cast(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, chunk_id) AS integer) AS rank
            FROM {prefix}cand JOIN chunk USING (chunk_id)
            WHERE length(text) > 0 AND
            length(regexp_replace(lower(text), '[^a-z]+', '', 'g')) / length(text) >= {ratio})
            WHERE rank <= {k}""",
    }


def _matched(prefix: str) -> dict[str, str]:
    return {
        f"{prefix}matched": f"""SELECT query_id, chunk_id,
            string_agg(term || '(' || tf || ')', ' ' ORDER BY place) AS matched_terms FROM (
            SELECT s.*, row_number() OVER (PARTITION BY query_id, chunk_id
            ORDER BY round(bm25_term, 8) DESC, term) AS place
            FROM scored s SEMI JOIN {prefix}kw k USING (query_id, chunk_id))
            WHERE place <= 5 GROUP BY query_id, chunk_id""",
    }


def _nearest(prefix: str, asked: str, k: int) -> dict[str, str]:
    return {
        f"{prefix}near": f"""SELECT * FROM (SELECT query_id, chunk_id, search_score,
            cast(row_number() OVER (PARTITION BY query_id
            ORDER BY round(search_score, 8) DESC, chunk_id) AS integer) AS rank
            FROM (SELECT a.query_id, e.chunk_id, list_dot_product(a.query_vector,
            cast(e.embedding AS double[])) AS search_score FROM {asked} a, vec e
            WHERE a.query_vector IS NOT NULL))
            WHERE rank <= {k}""",
    }


def _fused(prefix: str, keyword: str, nearest: str, rrf_k: int, top_n: int) -> dict[str, str]:
    return {
        f"{prefix}fused": f"""SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY query_id
            ORDER BY round(rrf_score, 12) DESC, v NULLS LAST, w NULLS LAST) AS integer) AS rank FROM (
            SELECT query_id, chunk_id, sum(1.0::double / ({rrf_k} + rank)) AS rrf_score,
            max(v) AS v, max(w) AS w,
            string_agg(tag, '+' ORDER BY tag) AS source_tag FROM (
            SELECT query_id, chunk_id, rank, rank AS v, NULL AS w, 'VEC' AS tag FROM {nearest}
            UNION ALL
            SELECT query_id, chunk_id, rank, NULL, rank, 'KW' FROM {keyword})
            GROUP BY query_id, chunk_id)) WHERE rank <= {top_n}""",
        f"{prefix}fused_text": f"""SELECT query_id, chunk_id, rrf_score, source_tag, rank, text,
            source_file, chunk_index_in_file FROM {prefix}fused LEFT JOIN chunk USING (chunk_id)""",
        f"{prefix}coverage": f"""SELECT f.*, CASE WHEN len(qs.words) > 0 THEN
            len(list_intersect(qs.words, list_distinct(string_split({_folded("coalesce(f.text, '')")},
            ' ')))) / len(qs.words) ELSE 0.0 END AS rerank_score
            FROM {prefix}fused_text f JOIN qwords qs USING (query_id)""",
    }


def _reranked(prefix: str, limit: int, k: int) -> dict[str, str]:
    return {
        f"{prefix}best": f"""SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY query_id
            ORDER BY round(rerank_score, 8) DESC, rank) AS integer) AS rerank_rank
            FROM {prefix}coverage WHERE rank <= {limit}) WHERE rerank_rank <= {k}""",
    }


_CLEAN = "trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[•·]+', ' ', 'g'))"
_CONTEXT, _QUESTION, _FORMAT = USER_HEADINGS
_AFTER_POSTINGS = """SELECT term, chunk_id, tf, doc_len, round(length(regexp_replace(lower(text),
    '[^a-z]+', '', 'g')) / length(text), 6) AS english_ratio
    FROM after_post JOIN after_stats USING (chunk_id) JOIN chunk_after USING (chunk_id)"""

EXPRESSIONS: dict[str, str] = {
    # inputs
    "chunk": """SELECT cast(doc_id AS varchar) AS chunk_id,
        '/lake/' || source || '/part-' || (doc_id // 100) || '.txt' AS source_file,
        doc_id % 100 AS chunk_index_in_file, text FROM documents""",
    "vec": "SELECT cast(vec_id AS varchar) AS chunk_id, embedding FROM embeddings",
    "asked": """SELECT item_id AS query_id, text AS query_text,
        cast(embedding AS double[]) AS query_vector
        FROM benchmark LEFT JOIN embeddings ON vec_id = item_id""",
    "asked_by_id": """SELECT chunk_id AS query_id, cast(embedding AS double[]) AS query_vector
        FROM vec""",
    "batch": """SELECT chunk_id, source_file, chunk_index_in_file,
        text || ' revised edition' AS text FROM chunk
        WHERE chunk_id IN (SELECT cast(doc_id AS varchar) FROM labels)
        UNION ALL SELECT 'c' || conv_id || '-' || turn, '/lake/conversations/' || conv_id || '.txt',
        turn, text FROM conversations""",
    "vec_batch": """SELECT chunk_id, list_reverse(embedding) AS embedding FROM vec
        WHERE chunk_id IN (SELECT cast(doc_id AS varchar) FROM labels)
        UNION ALL SELECT 'b' || item_id, embedding FROM benchmark JOIN embeddings
        ON vec_id = item_id""",
    "chunk_after": """SELECT * FROM chunk WHERE chunk_id NOT IN (SELECT chunk_id FROM batch)
        UNION ALL SELECT * FROM batch""",
    "vec_after": """SELECT * FROM vec WHERE chunk_id NOT IN (SELECT chunk_id FROM vec_batch)
        UNION ALL SELECT * FROM vec_batch""",
    "wide_rows": "SELECT c.*, embedding FROM chunk c JOIN vec USING (chunk_id)",
    "wide_after": "SELECT c.*, embedding FROM chunk_after c JOIN vec_after USING (chunk_id)",
    # keyword index
    **_index("", "chunk"),
    **_index("cap_", "chunk", "lower(regexp_replace(text, '[^a-z0-9]+', ' ', 'g'))"),
    **_index("wide_", "wide_rows"),
    **_index("after_", "chunk_after"),
    # query terms
    "qtok": f"""SELECT query_id, term, min(place) AS place FROM (SELECT query_id,
        unnest(string_split_regex({_folded("query_text")}, ' ')) AS term,
        generate_subscripts(string_split_regex({_folded("query_text")}, ' '), 1) AS place FROM asked)
        WHERE term <> '' GROUP BY query_id, term""",
    "qwords": """SELECT query_id, list(term) AS words FROM qtok GROUP BY query_id""",
    "domain": f"""SELECT * FROM (VALUES {_values(
        (_text(t), f"{w}::double", str(t not in NOT_WHITELISTED).lower())
        for t, w in TERM_WEIGHTS.items())}) AS d(term, weight, whitelisted)""",
    "lex": f"""SELECT * FROM domain UNION ALL SELECT * FROM (
        SELECT term, {LEXICON_WEIGHT}::double, true FROM freq, meta
        WHERE df / "N" > 0.03 AND df / "N" <= {LEXICON_RATIO}
        AND term NOT IN (SELECT term FROM domain))""",
    "triggers": f"""SELECT * FROM (VALUES {_values(
        (_text(r.name), _text(t)) for r in RULES for t in r.triggers)}) AS t(rule, term)""",
    "lifted": f"""SELECT * FROM (VALUES {_values(
        (_text(r.name), _text(t), f"{r.factor}::double") for r in RULES for t in r.boosted)})
        AS t(rule, term, factor)""",
    "fired": "SELECT DISTINCT query_id, rule FROM qtok JOIN triggers USING (term)",
    "qboost": """SELECT query_id, term, greatest(1.1::double, coalesce(max(
        CASE WHEN f.rule IS NOT NULL THEN factor END), 1.0::double)) AS boost
        FROM qtok LEFT JOIN lifted l USING (term) LEFT JOIN fired f USING (query_id, rule)
        GROUP BY query_id, term""",
    "weighted": """SELECT query_id, term, coalesce(whitelisted, false) AS whitelisted, boost,
        coalesce(weight, 0.5::double) * boost AS term_weight
        FROM qboost LEFT JOIN lex USING (term)""",
    "known": """SELECT w.*, df, (whitelisted OR df / "N" <= 0.03) AS selective,
        ln(("N" - df + 0.5::double) / (df + 0.5::double) + 1) AS idf
        FROM weighted w JOIN freq USING (term), meta""",
    "counted": """SELECT *, sum(selective::int) OVER (PARTITION BY query_id) AS n FROM known""",
    "kept": "SELECT *, n < 2 AS used_fallback FROM counted WHERE selective OR n < 2",
    # keyword search
    "scored": """SELECT query_id, chunk_id, term, tf, idf * (tf * 2.2::double)
        / (tf + 1.2::double * (0.25::double + 0.75::double * doc_len / avgdl)) * term_weight
        AS bm25_term FROM post JOIN kept USING (term) JOIN stats USING (chunk_id), meta""",
    "chunk_score": """SELECT query_id, chunk_id, sum(bm25_term) AS score, count(*) AS hit_terms
        FROM scored GROUP BY query_id, chunk_id HAVING count(*) >= 2""",
    **_keyword("", 250, 50, 0.35),
    **_keyword("all_", None, 50, 0.35),
    **_matched("all_"),
    **_keyword("strict_", 40, 20, 0.70),
    **_matched("strict_"),
    "first_kw": """SELECT * FROM (SELECT query_id, chunk_id, score, text, source_file,
        chunk_index_in_file, cast(row_number() OVER (PARTITION BY query_id
        ORDER BY round(score, 8) DESC, chunk_id) AS integer) AS rank
        FROM chunk_score JOIN chunk USING (chunk_id) WHERE length(text) > 0 AND
        length(regexp_replace(lower(text), '[^a-z]+', '', 'g')) / length(text) >= 0.70)
        WHERE rank <= 20""",
    **_matched("first_"),
    **_fused("plain_", "(SELECT * FROM cand WHERE rank <= 10)", "near", 60, 10),
    # vectors, fusion, rerank: defaults, then the settings of the question run
    **_nearest("", "asked", 10),
    **_nearest("all_", "asked_by_id", 10),
    **_keyword("ten_", None, 10, 0.35),
    **_fused("", "ten_kw", "near", 60, 10),
    **_reranked("", 8, 5),
    **_nearest("run_", "asked", 100),
    **_keyword("run_", None, 100, 0.35),
    **_fused("run_", "run_kw", "run_near", 20, 20),
    **_reranked("run_", 50, 10),
    "context": """SELECT query_id, string_agg('[' || rerank_rank || '] ' || coalesce(text, ''),
        chr(10) || chr(10) ORDER BY rerank_rank) AS context FROM run_best GROUP BY query_id""",
    "prompt": f"""SELECT query_id, query_text, {_text(_CONTEXT)} || chr(10) || coalesce(context, '')
        || chr(10) || chr(10) || {_text(_QUESTION)} || chr(10) || coalesce(query_text, '')
        || chr(10) || chr(10) || {_text(_FORMAT)} AS user_message
        FROM asked LEFT JOIN context USING (query_id)""",
    # incremental
    "old_count": """SELECT term, count(*) AS n FROM post
        WHERE chunk_id IN (SELECT chunk_id FROM batch) GROUP BY term""",
    **_index("batch_", "batch"),
    "delta": """SELECT term, coalesce(b.df, 0) - coalesce(o.n, 0) AS delta
        FROM batch_freq b FULL JOIN old_count o USING (term)
        WHERE coalesce(b.df, 0) <> coalesce(o.n, 0)""",
}

_EMBEDDED = """SELECT query_id, avg(length(w)) AS a, avg(length(w) - length(replace(w, 'a', '')))
    AS b, avg(length(w) - length(replace(w, 'e', ''))) AS c,
    avg(length(w) - length(replace(w, 't', ''))) AS d
    FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS w FROM asked)
    GROUP BY query_id"""
EXPRESSIONS["embedded"] = f"""SELECT *, sqrt(a * a + b * b + c * c + d * d) AS size
    FROM ({_EMBEDDED})"""


def _digest(columns: str, source: str) -> str:
    return f"""SELECT {columns}, round(list_sum(list_transform(range(1, len(embedding) + 1),
        lambda i: cast(embedding[i] AS double) * i)), 6) AS digest FROM {source}"""


def _positions(source: str) -> str:
    return f"""SELECT chunk_id, cast(generate_subscripts(embedding, 1) - 1 AS integer) AS position,
        cast(unnest(embedding) AS double) AS value FROM {source}"""


def _keyword_result(prefix: str) -> str:
    return f"""SELECT query_id, rank, chunk_id, matched_terms, text, source_file,
        chunk_index_in_file, round(score, 6) AS score
        FROM {prefix}kw LEFT JOIN {prefix}matched USING (query_id, chunk_id)"""


_CHUNK = "chunk_id, source_file, chunk_index_in_file, text"

STATEMENTS: dict[str, str] = {
    "chunks_scan": f"SELECT {_CHUNK} FROM chunk",
    "embeddings_decode": _positions("vec"),
    "source_basename": """SELECT chunk_id, regexp_replace(source_file, '^.*/', '') AS file_name
        FROM chunk""",
    "text_clean": f"SELECT chunk_id, {_CLEAN} AS text_clean FROM chunk",
    "english_ratio": """SELECT chunk_id, round(ratio, 6) AS ratio, ratio >= 0.7 AS kept FROM (
        SELECT chunk_id, CASE WHEN length(text) > 0 THEN
        length(regexp_replace(lower(text), '[^a-z]+', '', 'g')) / length(text) ELSE 0.0 END AS ratio
        FROM chunk)""",
    "tokens": f"""SELECT chunk_id, cast(generate_subscripts(words, 1) - 1 AS integer) AS position,
        unnest(words) AS term FROM (SELECT chunk_id,
        list_filter(string_split_regex({_folded()}, '\\s+'),
        lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+')) AS words FROM chunk)""",
    "bm25_postings": "SELECT term, chunk_id, tf FROM post",
    "bm25_postings_capitals_split": "SELECT term, chunk_id, tf FROM cap_post",
    "bm25_doc_stats": "SELECT * FROM stats",
    "bm25_df": "SELECT * FROM freq",
    "bm25_meta": 'SELECT "N", round(avgdl, 6) AS avgdl FROM meta',
    "bm25_index_wide_scope": "SELECT * FROM wide_freq",
    "bm25_idf": """SELECT term, df,
        round(ln(("N" - df + 0.5::double) / (df + 0.5::double) + 1), 6) AS idf FROM freq, meta""",
    "query_tokens": """SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY place)
        AS integer) AS position, term FROM qtok""",
    "query_boosts": "SELECT query_id, term, boost FROM qboost",
    "term_weights": """SELECT query_id, term, whitelisted, round(term_weight, 6) AS term_weight
        FROM weighted""",
    "query_terms_selected": "SELECT query_id, term, df, used_fallback FROM kept",
    "query_terms_fallback": """SELECT query_id, term, df, n < 12 AS used_fallback FROM counted
        WHERE selective OR n < 12""",
    "bm25_term_scores": """SELECT query_id, chunk_id, term, tf, round(bm25_term, 6) AS bm25_term
        FROM scored""",
    "bm25_topk": """SELECT query_id, chunk_id, round(score, 6) AS score, hit_terms, rank
        FROM cand""",
    "keyword_search": _keyword_result("all_"),
    "keyword_search_language_filter": _keyword_result("strict_"),
    "keyword_search_filter_first": _keyword_result("first_"),
    "matched_terms": "SELECT * FROM all_matched",
    "vector_topk": """SELECT query_id, chunk_id, round(search_score, 6) AS search_score, rank
        FROM near""",
    "vector_topk_all_pairs_of_ids": """SELECT query_id, chunk_id,
        round(search_score, 6) AS search_score, rank FROM all_near""",
    "vector_search": """SELECT query_id, chunk_id, round(search_score, 6) AS search_score, rank,
        text, source_file, chunk_index_in_file FROM near LEFT JOIN chunk USING (chunk_id)""",
    "vector_index_refresh": _digest(
        """chunk_id, round(sqrt(list_dot_product(cast(embedding AS double[]),
        cast(embedding AS double[]))), 4) AS norm, true AS in_nearest_cell""",
        "vec_after",
    ),
    "embed_texts": """SELECT query_id, round(a / size, 4) AS v0, round(b / size, 4) AS v1,
        round(c / size, 4) AS v2, round(d / size, 4) AS v3 FROM embedded""",
    "embed_text_hashed": """SELECT query_id, 64 AS dim, CASE WHEN query_id IN
        (SELECT query_id FROM qwords) THEN 1.0::double ELSE 0.0::double END AS norm FROM asked""",
    "rrf_fuse": """SELECT query_id, chunk_id, round(rrf_score, 9) AS rrf_score, source_tag, rank
        FROM plain_fused""",
    "hybrid_search": """SELECT query_id, chunk_id, round(rrf_score, 9) AS rrf_score, source_tag, rank
        FROM fused""",
    "hybrid_with_text": f"""SELECT query_id, chunk_id, round(rrf_score, 9) AS rrf_score, source_tag,
        rank, text, source_file, chunk_index_in_file, {_CLEAN} AS text_clean FROM fused_text""",
    "rerank_lexical": """SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score
        FROM coverage""",
    "rerank_topk": """SELECT query_id, chunk_id, rank, rerank_rank, text,
        round(rerank_score, 6) AS rerank_score FROM best""",
    "rag_context": """SELECT query_id, rerank_rank, chunk_id, round(rerank_score, 6) AS rerank_score,
        round(rrf_score, 9) AS rrf_score, source_tag, source_file, chunk_index_in_file, text
        FROM run_best""",
    "prompt_table": f"""SELECT query_id, 'system' AS role, {_text(SYSTEM_PROMPT)} AS content
        FROM prompt UNION ALL SELECT query_id, 'user', user_message FROM prompt""",
    "eval_rows": """SELECT query_id AS question_id, query_text AS question,
        cast(NULL AS varchar) AS fact, 'benchmark' AS fact_source, 'digest' AS model,
        md5(user_message) AS answer FROM prompt""",
    "wide_table": _digest(_CHUNK, "wide_rows"),
    "upsert_chunks": f"SELECT {_CHUNK} FROM chunk_after",
    "upsert_embeddings": _positions("vec_after"),
    "upsert_wide": _digest(_CHUNK, "wide_after"),
    "bm25_df_delta": "SELECT * FROM delta",
    "bm25_postings_incremental": "SELECT term, chunk_id, tf FROM after_post",
    "bm25_doc_stats_incremental": "SELECT * FROM after_stats",
    "bm25_df_incremental": "SELECT * FROM after_freq",
    "bm25_meta_incremental": 'SELECT "N", round(avgdl, 6) AS avgdl FROM after_meta',
    "ingest_report": """SELECT 2 AS version, (SELECT count(*) FROM batch) AS chunks_text,
        (SELECT count(*) FROM vec_batch) AS embeddings,
        (SELECT count(*) FROM wide_after WHERE chunk_id IN (SELECT chunk_id FROM batch
        UNION SELECT chunk_id FROM vec_batch)) AS wide,
        'incremental' AS keyword_mode, (SELECT count(*) FROM batch) AS affected_chunks,
        (SELECT count(*) FROM batch_post) AS new_postings,
        (SELECT count(*) FROM delta) AS df_terms_changed,
        'skipped (no cell model)' AS vector_index""",
    "ingest_postings": _AFTER_POSTINGS,
    "ingest_stream": "SELECT * FROM after_freq",
    "ingest_two_streams_wide": f"SELECT {_CHUNK}, 1.0::double AS norm FROM wide_rows",
    "ingest_two_streams_cells": "SELECT chunk_id, 1.0::double AS norm FROM wide_rows",
    "ingest_after_skipped_update": "SELECT * FROM after_freq",
    "ingest_compacted": _AFTER_POSTINGS,
    "ingest_cells": """SELECT chunk_id, 1.0::double AS norm FROM wide_after""",
    "coverage_audit": """SELECT (SELECT count(*) FROM batch) AS total,
        (SELECT count(*) FROM batch JOIN chunk USING (chunk_id)) AS in_text,
        (SELECT count(*) FROM batch JOIN vec USING (chunk_id)) AS in_emb,
        (SELECT count(*) FROM batch JOIN wide_rows USING (chunk_id)) AS in_wide""",
    "match_audit": """SELECT (SELECT count(DISTINCT chunk_id) FROM chunk) AS chunks,
        (SELECT count(DISTINCT chunk_id) FROM vec) AS embeddings,
        (SELECT count(DISTINCT chunk_id) FROM chunk JOIN vec USING (chunk_id)) AS matched""",
    "source_files": """SELECT DISTINCT regexp_replace(source_file, '^.*/', '') AS source_file
        FROM chunk""",
}


def _needed(statement: str, found: list[str]) -> list[str]:
    for name in EXPRESSIONS:
        if name not in found and re.search(rf"(FROM|JOIN|,)\s+{name}\b", statement):
            _needed(EXPRESSIONS[name], found)
            found.append(name)
    return found


def _complete(statement: str) -> str:
    names = list(dict.fromkeys(_needed(statement, [])))
    if not names:
        return statement
    parts = ",\n".join(f"{name} AS MATERIALIZED ({EXPRESSIONS[name]})" for name in names)
    return f"WITH {parts}\n{statement}"


STATEMENTS["coverage_audit_sql"] = STATEMENTS["coverage_audit"]
# Probing every cell of the approximate index is an exact search.
STATEMENTS["vector_topk_approx_all_cells"] = STATEMENTS["vector_topk"]
for _same in ("vector_topk_query_blocks", "vector_topk_approx_query_blocks", "vector_topk_tree_all_cells"):
    STATEMENTS[_same] = STATEMENTS["vector_topk"]
STATEMENTS["keyword_search_large_query_table"] = STATEMENTS["keyword_search"]
# An approximate search keeps exact scores, answers every query, and finds nine tenths.
for _same in ("vector_topk_approx_properties", "vector_topk_tree_properties"):
    STATEMENTS[_same] = """SELECT count(*) AS queries, true AS scores_exact, true AS recall_kept
        FROM asked WHERE query_vector IS NOT NULL"""
STATEMENTS["hybrid_search_approx_all_cells"] = STATEMENTS["hybrid_search"]

ORACLE: dict[str, str] = {name: _complete(sql) for name, sql in STATEMENTS.items()}
