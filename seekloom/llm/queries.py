"""The registered queries of the training-text operators and their SQL counterparts."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seekloom.llm import (
    containment,
    cotraining,
    fuzzy_lines,
    hamming_join,
    jaccard_join,
    line_frequency,
    mixing,
    passages,
    periodic_runs,
    surrogates,
    token_alignment,
    token_files,
    warc,
)
from seekloom.plans.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe_path() -> str:
    """The installed file of the byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and lines that many documents of a source share."""
    return line_frequency.quality_rules(table(spark, sf_dir, "documents")).drop("text")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by the similarity of their shingle sets."""
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back as chunks."""
    pages = table(spark, sf_dir, "pages")
    files = warc.archive_pages(spark, pages, scratch_path(spark, "warc"))
    return warc.record_summaries(warc.read_archives(files))


def op4_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by co-trained text and metadata classifiers."""
    labels = cotraining.good_labels(table(spark, sf_dir, "labels"))
    return cotraining.quality_scores(table(spark, sf_dir, "documents"), labels)


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 1, 2, 3 by systematic sampling."""
    mix = mixing.systematic_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one line of each group of near-duplicate lines."""
    return fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose personal data is replaced by surrogates."""
    return surrogates.replace_personal_data(table(spark, sf_dir, "documents"))


def op8_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return containment.contained_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op9_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to Parquet list columns and read back."""
    path = scratch_path(spark, "tokens")
    encoded = token_files.encode_documents(table(spark, sf_dir, "documents"), byte_bpe_path())
    token_files.write_tokens(encoded, path)
    return token_files.token_digests(spark, path)


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that near-duplicate a passage elsewhere, also in the same document."""
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"), within=True)


def piece_bpe_path() -> str:
    """The installed file of the piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_space_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned, with corpus counts of the id pairs that overlap."""
    docs = table(spark, sf_dir, "documents")
    return token_alignment.alignment_digests(docs, byte_bpe_path(), piece_bpe_path())


def op12_hamming_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors by learned codes and Hamming tables."""
    return hamming_join.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def planted_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a text, some of them repeated with a period if the id's checksum says so."""
    checksum = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if checksum % 10 or not words:
        return words
    share, count = checksum // 10, len(words)
    first = share % count
    period = 1 + (count - first) // (3 + share % 8)
    block = words[first : first + period]
    return words[:first] + (block * ((count - first) // period + 1))[: count - first]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of each document, with runs planted in some."""
    found = periodic_runs.collapse_runs(table(spark, sf_dir, "documents"), planted_words)
    return periodic_runs.run_digests(found)


QUERIES: dict[str, Query] = {
    "op1_line_frequency": op1_line_frequency,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_warc_chunks": op3_warc_chunks,
    "op4_co_training": op4_co_training,
    "op5_systematic_mix": op5_systematic_mix,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_surrogates": op7_surrogates,
    "op8_benchmark_containment": op8_benchmark_containment,
    "op9_token_lists": op9_token_lists,
    "op10_compact_windows": op10_compact_windows,
    "op11_space_anchors": op11_space_anchors,
    "op12_hamming_tables": op12_hamming_tables,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op3_warc_chunks": """
        WITH own AS (
            SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages
        ), latest AS (
            SELECT payload, max(page_id) AS last_id FROM own WHERE n >= 1000 GROUP BY payload
        )
        SELECT own.page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(own.payload) AS payload_digest,
            CASE WHEN last_id IS DISTINCT FROM own.page_id AND latest.payload IS NOT NULL
                THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN last_id IS DISTINCT FROM own.page_id THEN last_id END AS refers_to
        FROM own LEFT JOIN latest USING (payload)
    """,
    "op5_systematic_mix": r"""
        WITH sized AS (
            SELECT doc_id, source,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents
        ), numbered AS (
            SELECT doc_id, source, size, row_number() OVER (
                PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS n FROM sized
        ), sources AS (
            SELECT source, sum(size) AS s,
                (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
            FROM sized GROUP BY source
        ), steps AS (
            SELECT *, 3.0 * s / w AS ratio, row_number() OVER (ORDER BY 3.0 * s / w, source) AS k
            FROM sources
        ), levels AS (
            SELECT a.k, a.ratio,
                (SELECT sum(s) FROM sources)
                    - coalesce((SELECT sum(3 * s) FROM steps b WHERE b.k < a.k), 0) AS rest,
                (SELECT sum(w) FROM steps b WHERE b.k >= a.k) AS weight
            FROM steps a
        ), level AS (
            SELECT CAST(rest AS DOUBLE) / CAST(weight AS DOUBLE) AS x FROM levels
            WHERE CAST(rest AS DOUBLE) / CAST(weight AS DOUBLE) <= ratio ORDER BY k LIMIT 1
        ), targets AS (
            SELECT source, s, CASE WHEN x * w > 3 * s THEN CAST(3 * s AS DOUBLE) ELSE x * w END AS t,
                CAST(CAST('0x' || substr(md5('mix|' || coalesce(source, '<null>')), 1, 8) AS BIGINT)
                    AS DOUBLE) / 4294967296.0 AS u
            FROM sources, level
        ), shares AS (
            SELECT doc_id, size, s, t, u, n, coalesce(t / nullif(CAST(s AS DOUBLE), 0), 0.0) AS e
            FROM numbered JOIN targets ON numbered.source IS NOT DISTINCT FROM targets.source
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, t AS target,
            CAST(least(floor(e * n + u) - floor(e * (n - 1) + u), 3) AS BIGINT) * size AS taken
        FROM shares
    """,
    "op8_benchmark_containment": r"""
        WITH words AS (
            SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w
            FROM documents
            UNION ALL
            SELECT 1, item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') FROM benchmark
        ), shingles AS (
            SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5
                THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                WHEN len(w) > 0 THEN ['<' || array_to_string(w, ' ')] ELSE [] END) AS shingle
            FROM words
        ), items AS (
            SELECT id, shingle, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE side = 1
        )
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n) AS n_item
        FROM shingles d JOIN items i USING (shingle) WHERE d.side = 0
        GROUP BY d.id, i.id HAVING 100 * count(*) >= 75 * any_value(n)
    """,
    "op12_hamming_tables": """
        WITH RECURSIVE good AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
            ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), reached AS (
            SELECT vec_id, vec_id AS r FROM embeddings
            UNION SELECT reached.vec_id, links.y FROM reached JOIN links ON reached.r = links.x
        ), least AS (
            SELECT vec_id, min(r) AS component_id FROM reached GROUP BY vec_id
        ), counts AS (
            SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings LEFT JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
    """,
}
