"""Query embedding with a caller-supplied model, and a native baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekloom.functions.analyzer import query_tokens
from seekloom.plans.sizing import in_tasks

# A factory is called once per task and returns the model: a callable that takes texts
# and gives token vectors [batch, tokens, dim] with their mask [batch, tokens].
TokenModel = Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]


def mean_pool(token_vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the unmasked tokens, scaled to length one."""
    weights = mask[:, :, None].astype(np.float64)
    pooled = (token_vectors * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9)
    length = np.linalg.norm(pooled, axis=1, keepdims=True)
    return pooled / np.maximum(length, 1e-12)


def embed_texts(
    frame: DataFrame,
    factory: Callable[[], TokenModel],
    text_col: str = "query_text",
    vector_col: str = "query_vector",
    batch_size: int = 16,
    tasks: int | None = None,
) -> DataFrame:
    """Add ``vector_col``: mean-pooled, normalised model output for each text.

    The model is built once per task on the executors. Null text is embedded as "".
    """
    schema = T.StructType(
        [*frame.schema.fields, T.StructField(vector_col, T.ArrayType(T.FloatType()))]
    )

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            texts = [text or "" for text in batch.column(text_col).to_pylist()]
            if not texts:
                continue
            model = model or factory()
            vectors = [
                row
                for start in range(0, len(texts), batch_size)
                for row in mean_pool(*model(texts[start : start + batch_size])).astype(np.float32)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(vectors, pa.list_(pa.float32()))],
                names=[*batch.schema.names, vector_col],
            )

    return in_tasks(frame, tasks).mapInArrow(embed, schema)


def embed_hashed(
    frame: DataFrame,
    dim: int,
    text_col: str = "query_text",
    vector_col: str = "query_vector",
) -> DataFrame:
    """Baseline without a model: hashed bag of query tokens, scaled to length one."""
    tokens = frame.withColumn("_tokens", query_tokens(text_col))
    counted = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_counts").transform(tokens)
    scaled = Normalizer(inputCol="_counts", outputCol="_scaled").transform(counted)
    return scaled.withColumn(vector_col, vector_to_array(F.col("_scaled"), "float32")).drop(
        "_tokens", "_counts", "_scaled"
    )
