"""The bundled tables seen as chunks, vectors, queries and ingest batches."""

from __future__ import annotations

import io
import json
import re

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekloom.config import EMBEDDING_DIR, IDS_FILE, VECTOR_FILE, KeywordConfig, LakeConfig
from seekloom.operators.bm25_index import KeywordIndex, write_index
from seekloom.operators.cell_tree import assign_tree_cells, fit_cell_tree
from seekloom.operators.lexicon import BOOST_RULES, BoostRule, Lexicon
from seekloom.operators.vectors import assign_cells, fit_cells
from seekloom.plans.ingest import ingest
from seekloom.plans.scratch import scratch_path, written
from seekloom.plans.sizing import keys_fit
from seekloom.sources.chunks import stored_chunks
from seekloom.sources.snapshots import Snapshot, current

MODEL = "fixture-model"
SHARD_ROWS = 512
CELLS = 16
TREE_COARSE, TREE_ROWS = 4, 50
LEXICON_RATIO = 0.04
LEXICON_WEIGHT = 2.0
# A rule over words of the bundled texts, beside the domain rules.
FIXTURE_RULE = BoostRule(
    "fixture", ("the", "that", "than"), ("ention", "estion", "heon", "onth", "thion"), 1.6
)
RULES = (*BOOST_RULES, FIXTURE_RULE)

_built: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build):
    """Build a stored table set once per application and input directory."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One bundled table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk; a hundred documents share a file."""
    documents = table(spark, sf_dir, "documents").drop("lang", "n_chars")
    # A small file has one split; a run may state in how many tasks its texts are analysed.
    if tasks := spark.conf.get("spark.seekloom.scan.tasks", None):
        documents = documents.repartition(int(tasks))
    return documents.select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.concat(
            F.lit("/lake/"),
            "source",
            F.lit("/part-"),
            F.floor(F.col("doc_id") / 100).cast("string"),
            F.lit(".txt"),
        ).alias("source_file"),
        F.pmod("doc_id", F.lit(100)).alias("chunk_index_in_file"),
        "text",
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), "embedding"
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored chunk table, as ingest writes it."""
    return once(
        spark,
        sf_dir,
        "chunks",
        lambda: written(stored_chunks(chunks(spark, sf_dir)), "chunks"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark passages as queries, with the vector of the same number."""

    def build() -> DataFrame:
        vectors = table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector")
        )
        passages = table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left")
        return written(
            passages.select(
                F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "query_vector"
            ),
            "queries",
        )

    return once(spark, sf_dir, "queries", build)


def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingest batch: all labelled documents with a changed text, all conversation turns."""
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))
    revised = (
        chunks(spark, sf_dir)
        .join(labelled, "chunk_id", "left_semi")
        .withColumn("text", F.concat("text", F.lit(" revised edition")))
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("chunk_id"),
        F.concat(F.lit("/lake/conversations/"), "conv_id", F.lit(".txt")).alias("source_file"),
        F.col("turn").alias("chunk_index_in_file"),
        "text",
    )
    return revised.unionByName(turns)


def batch_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector batch: labelled ids with reversed vectors, and one new id per query."""
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))
    reversed_ = (
        embeddings(spark, sf_dir)
        .join(labelled, "chunk_id", "left_semi")
        .withColumn("embedding", F.reverse("embedding"))
    )
    new = (
        queries(spark, sf_dir)
        .filter(F.col("query_vector").isNotNull())
        .select(
            F.concat(F.lit("b"), "query_id").alias("chunk_id"),
            F.col("query_vector").alias("embedding"),
        )
    )
    return reversed_.unionByName(new)


def index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The stored keyword index of all chunks."""
    return once(
        spark,
        sf_dir,
        "index",
        lambda: write_index(chunks(spark, sf_dir), chunk_buckets=2, term_buckets=4),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """The domain lexicon and all terms in the band above the selectivity cut."""

    def build() -> Lexicon:
        domain = Lexicon.from_terms(spark).terms
        stored = index(spark, sf_dir)
        n_chunks = stored.meta.select(F.col("N").cast("double")).scalar()
        frequent = (
            stored.df.filter(F.col("df") / n_chunks > KeywordConfig().df_ratio_max)
            .filter(F.col("df") / n_chunks <= LEXICON_RATIO)
            .join(F.broadcast(domain), "term", "left_anti")
            .select(
                "term",
                F.lit(LEXICON_WEIGHT).alias("weight"),
                F.lit(True).alias("whitelisted"),
            )
        )
        return Lexicon.from_frame(written(domain.unionByName(frequent), "lexicon"), RULES)

    return once(spark, sf_dir, "lexicon", build)


def cells(spark: SparkSession, sf_dir: str):
    """The cell model and the stored approximate index, partitioned by cell."""

    def build():
        corpus = embeddings(spark, sf_dir)
        model = fit_cells(corpus, n_cells=CELLS)
        path = scratch_path(spark, "cells")
        assign_cells(corpus, model).write.partitionBy("cell").parquet(path)
        return model, spark.read.schema(
            "chunk_id string, embedding array<float>, cell int"
        ).parquet(path)

    return once(spark, sf_dir, "cells", build)


def cell_tree(spark: SparkSession, sf_dir: str):
    """The two-level cell tree and its stored index, partitioned by fine cell."""

    def build():
        corpus = embeddings(spark, sf_dir)
        tree = fit_cell_tree(corpus, n_coarse=TREE_COARSE, cell_rows=TREE_ROWS)
        path = scratch_path(spark, "tree-cells")
        assign_tree_cells(corpus, tree).write.partitionBy("cell").parquet(path)
        return tree, spark.read.schema(
            "chunk_id string, embedding array<float>, cell int"
        ).parquet(path)

    return once(spark, sf_dir, "cell-tree", build)


def batch_fits(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the ids of both batches together may be broadcast."""
    return once(
        spark,
        sf_dir,
        "batch-fits",
        lambda: keys_fit(
            batch_chunks(spark, sf_dir)
            .select("chunk_id")
            .unionByName(batch_embeddings(spark, sf_dir).select("chunk_id")),
            "chunk_id",
        ),
    )


def ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Snapshot]:
    """All chunks and vectors ingested into a new lake, then the batches; the last report."""

    def build():
        lake = LakeConfig(scratch_path(spark, "lake"), chunk_buckets=2, term_buckets=2)
        ingest(spark, lake, chunks(spark, sf_dir), embeddings(spark, sf_dir))
        report = ingest(spark, lake, batch_chunks(spark, sf_dir), batch_embeddings(spark, sf_dir))
        return report, current(spark, lake)

    return once(spark, sf_dir, "ingested", build)


def shard_base(spark: SparkSession, sf_dir: str) -> str:
    """All vectors written as shard files below a folder: a matrix and an id list each."""

    def build() -> str:
        base = scratch_path(spark, "shards")
        folder = f"{base}/{EMBEDDING_DIR}/{MODEL}"

        def encode(rows: pd.DataFrame) -> pd.DataFrame:
            buffer = io.BytesIO()
            np.save(buffer, np.stack(rows["embedding"].to_numpy()).astype(np.float32))
            ids = json.dumps(list(rows["chunk_id"])).encode()
            shard = f"{folder}/shard-{rows['shard'].iloc[0]}"
            for name, data in ((VECTOR_FILE, buffer.getvalue()), (IDS_FILE, ids)):
                store, path = fs.FileSystem.from_uri(_as_uri(f"{shard}/{name}"))
                store.create_dir(path.rsplit("/", 1)[0])
                with store.open_output_stream(path) as file:
                    file.write(data)
            return pd.DataFrame({"rows": [len(rows)]})

        written_rows = (
            embeddings(spark, sf_dir)
            .withColumn("shard", F.floor(F.col("chunk_id").cast("long") / SHARD_ROWS))
            .groupBy("shard")
            .applyInPandas(encode, "rows long")
        )
        written(written_rows, "shard-counts")
        return f"{base}/{EMBEDDING_DIR}"

    return once(spark, sf_dir, "shards", build)


def _as_uri(path: str) -> str:
    """A path that Arrow opens: local ones, and ``file:`` with one slash, as ``file:///``."""
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith(("/", "file:")) else path


def counting_model():
    """A small deterministic token model: length and three letter counts of every token."""

    def model(texts):
        tokens = [re.findall(r"[a-z0-9]+", text.lower()) for text in texts]
        width = max(1, max(len(words) for words in tokens))
        vectors = np.zeros((len(texts), width, 4))
        mask = np.zeros((len(texts), width))
        for row, words in enumerate(tokens):
            for at, word in enumerate(words):
                vectors[row, at] = [len(word), word.count("a"), word.count("e"), word.count("t")]
                mask[row, at] = 1
        return vectors, mask

    return model
