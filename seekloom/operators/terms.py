"""From query texts to weighted query terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekloom.config import KeywordConfig
from seekloom.functions.analyzer import query_tokens
from seekloom.functions.scoring import idf
from seekloom.operators.bm25_index import KeywordIndex
from seekloom.operators.lexicon import DEFAULT_WEIGHT, Lexicon, boost, fired_factors
from seekloom.plans.joins import join_by_known_rows
from seekloom.plans.sizing import QuerySize, hinted, measure_queries


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, position, term)``: distinct tokens of each query, 1-based."""
    return queries.select(
        "query_id", F.posexplode(query_tokens("query_text")).alias("position", "term")
    ).withColumn("position", F.col("position") + 1)


def weighted_terms(queries: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(query_id, term, whitelisted, static_weight, boost, term_weight)`` per query term.

    Whether a rule fires depends on the other terms of the same query only, so that is
    settled on the query row before its terms are exploded.
    """
    tokens = queries.select("query_id", query_tokens("query_text").alias("tokens"))
    exploded = tokens.select(
        "query_id", *fired_factors(F.col("tokens"), lexicon.rules), F.explode("tokens").alias("term")
    ).select("query_id", "term", boost(F.col("term"), lexicon.rules).alias("boost"))
    static = F.coalesce(F.col("weight"), F.lit(DEFAULT_WEIGHT))
    return (
        exploded.join(hinted(lexicon.terms, lexicon.fits), "term", "left")
        .select(
            "query_id",
            "term",
            F.coalesce(F.col("whitelisted"), F.lit(False)).alias("whitelisted"),
            static.alias("static_weight"),
            "boost",
            (static * F.col("boost")).alias("term_weight"),
        )
    )


def known_terms(
    queries: DataFrame, index: KeywordIndex, lexicon: Lexicon, size: QuerySize | None = None
) -> DataFrame:
    """Weighted query terms that occur in the index, with ``df``, ``df_ratio`` and ``idf``."""
    size = size or measure_queries(queries)
    weighted, keys = index.with_term_bucket(weighted_terms(queries, lexicon), index.df)
    frequencies = index.frequencies_of(query_terms(queries), size.terms_fit())
    n_chunks = index.meta.select(F.col("N").cast("double")).scalar()
    if size.terms_fit():
        known = frequencies.join(F.broadcast(weighted), keys)
    else:
        # A term has one df row but may be in every query, so the queries of such a term are spread.
        asked = query_terms(queries).groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
        known = join_by_known_rows(weighted, frequencies, keys, asked, "term", "query_id", False, merge=True)
    return known.drop("term_bucket").withColumns(
        {"df_ratio": F.col("df") / n_chunks, "idf": idf(n_chunks, F.col("df"))}
    )


def select_terms(
    queries: DataFrame,
    index: KeywordIndex,
    lexicon: Lexicon,
    config: KeywordConfig = KeywordConfig(),
    size: QuerySize | None = None,
) -> DataFrame:
    """The terms a query searches with.

    Known terms that are whitelisted or rare enough; all known terms of the query if
    fewer than ``min_terms`` of them qualify (``used_fallback``).
    """
    known = known_terms(queries, index, lexicon, size).withColumn(
        "selective", F.col("whitelisted") | (F.col("df_ratio") <= config.df_ratio_max)
    )
    per_query = Window.partitionBy("query_id")
    n_selective = F.sum(F.col("selective").cast("int")).over(per_query)
    return (
        known.withColumn("used_fallback", n_selective < config.min_terms)
        .filter(F.col("selective") | F.col("used_fallback"))
        .drop("selective")
    )
