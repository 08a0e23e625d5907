"""Text analysis as column expressions.

Documents keep runs of at least three ASCII letters/digits that are not all digits;
queries keep every run, once, in order of first appearance. One regular expression
finds the runs directly, so a text is walked once and nothing has to be split,
exploded and filtered afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A maximal run of [a-z0-9], three or more long, holding at least one letter. It can only
# begin where a run begins, and its leading digits are not tried again once a run turns
# out to have no letter, so a text of digits alone is walked once.
DOCUMENT_RUN = r"(?<![a-z0-9])(?=[a-z0-9]{3})[0-9]*+[a-z][a-z0-9]*+"
QUERY_RUN = r"[a-z0-9]+"
COUNTED_ROWS = 512  # chunks whose terms are counted together in a task


def document_tokens(text: Column | str, lower_first: bool = True) -> Column:
    """Tokens of a chunk text in order; null text gives null.

    ``lower_first=False`` treats capitals as separators instead of folding them.
    """
    text = F.col(text) if isinstance(text, str) else text
    source = F.lower(text) if lower_first else text
    return F.regexp_extract_all(source, F.lit(DOCUMENT_RUN), F.lit(0))


def query_tokens(text: Column | str) -> Column:
    """Distinct query tokens in order of first appearance; null text gives an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    runs = F.regexp_extract_all(F.lower(text), F.lit(QUERY_RUN), F.lit(0))
    return F.coalesce(F.array_distinct(runs), F.array().cast("array<string>"))


def term_counts(chunks: DataFrame, lower_first: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(term, chunk_id, tf, doc_len)``, one row per term of each chunk, without a shuffle.

    Columns of the chunk named in ``carried`` follow on every row of its terms.

    The tokens of a row are sorted, so equal terms are neighbours and a term's count is
    the distance to the next run's start; runs are cut for a whole Arrow batch at once. Every
    chunk is one row, so nothing has to be exchanged to count its terms; ``doc_len`` rides
    along for the same reason.
    """
    # Texts are walked once: what follows neither filters by the tokens nor explodes them in Spark,
    # for which it would work them out again.
    tokens = chunks.select(
        "chunk_id", F.sort_array(document_tokens("text", lower_first)).alias("tokens"), *carried
    )
    kept = ["chunk_id", *carried]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                part = batch.slice(start, COUNTED_ROWS)
                terms, at, lengths = _runs(part.column("tokens"))
                if not len(at):
                    continue
                ends = np.cumsum(lengths)
                row = np.searchsorted(ends, at, side="right")
                columns = {name: part.column(name).take(pa.array(row)) for name in kept}
                columns["term"] = terms.take(pa.array(at))
                columns["tf"] = pa.array(np.diff(np.append(at, len(terms))).astype(np.int32))
                columns["doc_len"] = pa.array(lengths[row].astype(np.int32))
                yield pa.RecordBatch.from_arrays([columns[n] for n in schema.fieldNames()], schema.fieldNames())

    held = {field.name: field for field in tokens.schema.fields}
    schema = T.StructType(
        [
            T.StructField("term", T.StringType()),
            held["chunk_id"],
            T.StructField("tf", T.IntegerType()),
            T.StructField("doc_len", T.IntegerType()),
            *(held[name] for name in carried),
        ]
    )
    return tokens.mapInArrow(runs, schema)


def _runs(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The tokens of sorted lists one after the other, where runs of equal ones begin, the list lengths."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = lists.flatten()
    begins = np.zeros(len(terms), dtype=bool)
    if len(terms):
        begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        different = pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1))
        begins[1:] |= different.to_numpy(zero_copy_only=False)
    return terms, np.flatnonzero(begins), lengths
