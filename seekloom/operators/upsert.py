"""Upserts as pure frames: the table after the batch, from the table before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekloom.plans.sizing import hinted


def latest_per_key(
    batch: DataFrame, key: str = "chunk_id", prefer: list[str] | None = None
) -> DataFrame:
    """One row per key: the one greatest by ``prefer``, then by the other columns.

    An aggregate rather than a window, so repeated keys shrink before the shuffle and
    one key repeated many times never gathers in a single task.
    """
    prefer = prefer or []
    others = prefer + [name for name in batch.columns if name not in [key, *prefer]]
    kept = batch.groupBy(key).agg(F.max(F.struct(*others)).alias("kept"))
    return kept.select(*[F.col(n) if n == key else F.col(f"kept.{n}") for n in batch.columns])


def upsert(target: DataFrame, batch: DataFrame, fits: bool, key: str = "chunk_id") -> DataFrame:
    """Target rows whose key is not in the batch, plus the batch (unique keys)."""
    return without_keys(target, batch.select(key), fits, key).unionByName(batch)


def without_keys(
    target: DataFrame, keys: DataFrame, fits: bool, key: str | list[str] = "chunk_id"
) -> DataFrame:
    """Delete by key set; ``fits`` says whether the key set was measured to be small."""
    return target.join(hinted(keys, fits), key, "left_anti")


def wide_table(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks that have a vector, with it."""
    return chunks.join(embeddings.select("chunk_id", "embedding"), "chunk_id", "inner")


def wide_after_batch(
    wide: DataFrame,
    chunks: DataFrame,
    embeddings: DataFrame,
    changed_ids: DataFrame,
    fits: bool,
) -> DataFrame:
    """The wide table after a batch, from the *merged* chunk and embedding tables.

    ``changed_ids`` are all ids the batch touched on either side, so a chunk that came
    without its vector still meets the vector stored earlier.
    """
    return without_keys(wide, changed_ids, fits).unionByName(
        changed_wide_rows(chunks, embeddings, changed_ids, fits)
    )


def changed_wide_rows(
    chunks: DataFrame, embeddings: DataFrame, changed_ids: DataFrame, fits: bool
) -> DataFrame:
    """The wide rows of the changed ids only."""
    ids = hinted(changed_ids, fits)
    return wide_table(
        chunks.join(ids, "chunk_id", "left_semi"), embeddings.join(ids, "chunk_id", "left_semi")
    )
