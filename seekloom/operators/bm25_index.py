"""The keyword index: postings, document lengths, document frequencies, meta.

``doc_len`` is stored on every posting. It is known when the chunk is tokenised and
changes only when the whole chunk is replaced, so keeping it there removes the join of
all scored postings with the length table from every query. The language ratio is there
for the same reason: a search that filters by it leaves postings out where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekloom.functions.analyzer import document_tokens, term_counts
from seekloom.functions.text import english_ratio
from seekloom.plans.scratch import scratch_path
from seekloom.plans.sizing import hinted, lane
from seekloom.schemas import BUCKETED_FREQUENCY, BUCKETED_POSTINGS, DOC_STATS, META, POSTINGS

BUCKETED = ["chunk_bucket", "chunk_id"]
TASK_TEXT = 16 * 1024 * 1024  # bytes of text whose postings one task sorts and writes


@dataclass(frozen=True)
class KeywordIndex:
    """The four index frames and, if the postings are bucketed, the bucket counts.

    ``df_parts`` are the rows that ``df`` is the sum of, where frequencies are stored as one
    table and the changes of later batches.
    """

    postings: DataFrame
    doc_stats: DataFrame
    df: DataFrame
    meta: DataFrame
    chunk_buckets: int = 0
    term_buckets: int = 0
    df_parts: DataFrame | None = None

    def frequencies_of(self, terms: DataFrame, fits: bool) -> DataFrame:
        """``df`` of at least the terms in ``terms``, with the join columns of :meth:`with_term_bucket`.

        Changes are added up for these terms only, not for the whole vocabulary.
        """
        if self.df_parts is None:
            return self.df
        wanted, keys = self.with_term_bucket(terms.select("term").distinct(), self.df_parts)
        return summed_frequencies(self.df_parts.join(hinted(wanted, fits), keys, "left_semi"))

    def with_term_bucket(self, frame: DataFrame, table: DataFrame) -> tuple[DataFrame, list[str]]:
        """A term-keyed frame with the join columns that let Spark prune the table's partitions."""
        if not self.term_buckets or "term_bucket" not in table.columns:
            return frame, ["term"]
        return frame.withColumn("term_bucket", lane("term", self.term_buckets)), [
            "term_bucket",
            "term",
        ]


def bucketed_ids(ids: DataFrame, chunk_buckets: int) -> tuple[DataFrame, list[str]]:
    """Chunk ids with the join columns that prune chunk buckets, if there are any.

    Spark prunes partitions at run time only if the other side of the join is filtered by
    a comparison, hence the one that always holds.
    """
    if not chunk_buckets:
        return ids.select("chunk_id"), ["chunk_id"]
    keyed = ids.select(lane("chunk_id", chunk_buckets).alias("chunk_bucket"), "chunk_id")
    return keyed.filter(F.col("chunk_bucket") >= 0), BUCKETED


def indexable(chunks: DataFrame) -> DataFrame:
    """What the index needs of a chunk: its id, its text and the language ratio, if that is stored."""
    stored = ["english_ratio"] if "english_ratio" in chunks.columns else []
    return chunks.select("chunk_id", "text", *stored)


def postings(chunks: DataFrame, lower_first: bool = True) -> DataFrame:
    """One row per (term, chunk): ``term, chunk_id, tf, doc_len, english_ratio``. Ids must be unique.

    The ratio is taken from the chunk table where it is stored, else computed once per chunk.
    """
    if "english_ratio" not in chunks.columns:
        chunks = chunks.withColumn("english_ratio", english_ratio("text"))
    return term_counts(chunks, lower_first, ("english_ratio",))


def doc_stats(chunks: DataFrame, lower_first: bool = True) -> DataFrame:
    """Token count of every chunk that has at least one token; no shuffle."""
    return chunks.select(
        "chunk_id", F.size(document_tokens("text", lower_first)).alias("doc_len")
    ).filter(F.col("doc_len") > 0)


def doc_stats_from_postings(posting_rows: DataFrame) -> DataFrame:
    """The same from stored postings, reading two columns instead of the texts."""
    return posting_rows.groupBy("chunk_id").agg(F.max("doc_len").alias("doc_len"))


def document_frequency(posting_rows: DataFrame) -> DataFrame:
    """Chunks per term."""
    return posting_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def summed_frequencies(parts: DataFrame) -> DataFrame:
    """Chunks per term from a table of frequencies and its later changes; terms at zero go."""
    keys = [name for name in ("term", "term_bucket") if name in parts.columns]
    return parts.groupBy(*keys).agg(F.sum("df").alias("df")).filter(F.col("df") > 0)


def meta_part(stats: DataFrame, sign: int = 1) -> DataFrame:
    """One row: number of indexed chunks and the sum of their lengths, or what is to be taken off."""
    return stats.agg(
        (sign * F.count(F.lit(1))).cast("long").alias("N"),
        (sign * F.coalesce(F.sum("doc_len"), F.lit(0))).cast("long").alias("length"),
    )


def meta_of_parts(parts: DataFrame) -> DataFrame:
    """``N`` and ``avgdl`` from the stored sums and their changes."""
    sums = parts.agg(F.coalesce(F.sum("N"), F.lit(0)).alias("N"), F.sum("length").alias("length"))
    return sums.select("N", F.when(F.col("N") > 0, F.col("length") / F.col("N")).alias("avgdl"))


def meta(stats: DataFrame) -> DataFrame:
    """One row: number of indexed chunks and their mean length."""
    return stats.agg(
        F.count(F.lit(1)).alias("N"), F.avg("doc_len").cast("double").alias("avgdl")
    )


def build_index(chunks: DataFrame, lower_first: bool = True) -> KeywordIndex:
    """The index as four lazy frames over the chunk table."""
    rows = postings(chunks, lower_first)
    stats = doc_stats(chunks, lower_first)
    return KeywordIndex(rows, stats, document_frequency(rows), meta(stats))


def index_scope(chunks: DataFrame, embeddings: DataFrame, scope: str) -> DataFrame:
    """The chunks to index: all of them, or only those that have a vector (``wide``)."""
    if scope == "chunks":
        return chunks
    if scope == "wide":
        return chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_semi")
    raise ValueError(f"unknown index scope: {scope}")


def deal_chunks(chunks: DataFrame, chunk_buckets: int, task_bytes: int = TASK_TEXT) -> DataFrame:
    """Stored chunks dealt for indexing: about ``task_bytes`` of text a task, of one chunk bucket or of several small ones.

    Postings are several times the size of their texts, so the texts are exchanged and the
    postings are sorted and written where they are made.
    """
    size = chunks.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks, bucket = max(1, -(-size // task_bytes)), lane("chunk_id", chunk_buckets)
    if tasks <= chunk_buckets:
        return chunks.repartitionById(tasks, F.pmod(bucket, F.lit(tasks)).cast("int"))
    lanes = -(-tasks // chunk_buckets)
    # Not the hash that the bucket is made from.
    within = F.pmod(F.hash("chunk_id"), F.lit(lanes))
    return chunks.repartitionById(chunk_buckets * lanes, (bucket * lanes + within).cast("int"))


def arrange_postings(rows: DataFrame, chunk_buckets: int, term_buckets: int) -> DataFrame:
    """Postings of dealt chunks laid out for writing by (chunk bucket, term bucket), sorted by term."""
    return (
        rows.withColumn("chunk_bucket", lane("chunk_id", chunk_buckets))
        .withColumn("term_bucket", lane("term", term_buckets))
        .sortWithinPartitions("chunk_bucket", "term_bucket", "term", "chunk_id")
    )


def arrange_frequencies(df: DataFrame, term_buckets: int) -> DataFrame:
    """Document frequencies laid out for writing by term bucket, sorted by term."""
    return (
        df.select("term", "df", lane("term", term_buckets).alias("term_bucket"))
        .hint("rebalance", "term_bucket")
        .sortWithinPartitions("term_bucket", "term")
    )


def write_index(
    chunks: DataFrame,
    path: str | None = None,
    lower_first: bool = True,
    chunk_buckets: int = 64,
    term_buckets: int = 16,
) -> KeywordIndex:
    """Build the index into Parquet tables, reading and tokenising the texts once."""
    spark = chunks.sparkSession
    path = path or scratch_path(spark, "keyword-index")
    (
        arrange_postings(postings(deal_chunks(indexable(chunks), chunk_buckets), lower_first), chunk_buckets, term_buckets)
        .write.partitionBy("chunk_bucket", "term_bucket")
        .parquet(f"{path}/postings")
    )
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    doc_stats_from_postings(stored).write.parquet(f"{path}/doc_stats")
    (
        arrange_frequencies(document_frequency(stored), term_buckets)
        .write.partitionBy("term_bucket")
        .parquet(f"{path}/df")
    )
    meta(spark.read.schema(DOC_STATS).parquet(f"{path}/doc_stats")).write.parquet(f"{path}/meta")
    return read_index(spark, path, chunk_buckets, term_buckets)


def read_index(spark, path: str, chunk_buckets: int, term_buckets: int) -> KeywordIndex:
    """The index tables under a path written by :func:`write_index`."""
    return KeywordIndex(
        spark.read.schema(BUCKETED_POSTINGS).parquet(f"{path}/postings"),
        spark.read.schema(DOC_STATS).parquet(f"{path}/doc_stats"),
        spark.read.schema(BUCKETED_FREQUENCY).parquet(f"{path}/df"),
        spark.read.schema(META).parquet(f"{path}/meta"),
        chunk_buckets,
        term_buckets,
    )
