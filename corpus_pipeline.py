"""A corpus pipeline: reject, deduplicate, decontaminate, mix and encode documents.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. Its
result is written as Parquet and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekloom.llm import containment, cotraining, jaccard_join, mixing, token_files
from seekloom.llm.queries import byte_bpe_path, table
from seekloom.plans.scratch import scratch_path, written
from seekloom.plans.sizing import hinted, keys_fit

BATCH_BYTES = 1024 * 1024  # of rows that Spark hands to a Python worker together
PIECES = 100_000  # that a worker remembers while it encodes, as it holds other stages' memory too
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch for Python workers in this session, unless it has a smaller bound.

    Spark's own bound lets 10,000 texts of any usual length through, which executor and worker
    both hold; the rows and their results do not depend on it.
    """
    held = spark.conf.get(_BATCH_BYTES).lower()
    number, unit = int(held.rstrip("bkmgtp")), held.lstrip("0123456789").removesuffix("b")
    if number * 1024 ** "bkmgtp".index(unit or "b") > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in the stored frame ``ids``."""
    gone = ids.select(F.col("doc_id").alias("_gone"))
    return docs.join(hinted(gone, keys_fit(gone, "_gone")), F.col("doc_id") == F.col("_gone"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers take for good ones.

    Null text is judged as an empty text; without labels of both classes all stay.
    """
    bounded_batches(spark)
    model = cotraining.fit(docs, cotraining.good_labels(table(spark, sf_dir, "labels")))
    return cotraining.kept_documents(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: that with the smallest id.

    Documents without a word, or without an id, are like no other and stay. Of rows that
    share an id one stays.
    """
    bounded_batches(spark)
    classes = written(jaccard_join.jaccard_classes(docs), "classes")
    others = written(classes.filter("doc_id != component_id").select("doc_id").distinct(), "others")
    left = without_ids(docs, others)
    repeated = classes.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1")
    repeated = written(repeated.select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    first = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return without_ids(left, repeated).unionByName(first.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    found = containment.contained_items(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, written(found.select("doc_id").distinct(), "contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come near weights of 1, 2, 3 in turn."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in list columns, and what reading them back gives for each row."""
    bounded_batches(spark)
    path = scratch_path(spark, "pipeline-tokens")
    token_files.write_tokens(token_files.encode_documents(docs, byte_bpe_path(), pieces=PIECES), path)
    return token_files.token_digests(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID output", tokens),
]

# The classifier is trained, which SQL cannot express; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
