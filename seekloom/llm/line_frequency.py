"""Quality rules: lines that many documents of a host share, and what is left without them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from seekloom.plans.scratch import written
from seekloom.plans.sizing import hinted, keys_fit

MAX_DOCS = 10
MIN_WORDS = 50
MAX_REPEATED = 50
MAX_REMOVED = 50

_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
_DIGITS = bytes(range(48, 58))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_AS_ZERO = bytes.maketrans(_DIGITS, b"0" * 10)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words")
_CLEANED = pa.schema(
    [("doc_id", pa.int64())] + [(name, pa.int64()) for name in _COUNTS] + [("text", pa.string())]
)
_CLEANED_SCHEMA = "doc_id long, " + ", ".join(f"{name} long" for name in _COUNTS) + ", text string"
_SLICE_BYTES = 8 * 1024 * 1024  # texts put together before a batch is handed on


def _long(data: bytes) -> int:
    return xxh3_64_intdigest(data) - (1 << 63)


def normal_line(line: bytes) -> bytes:
    """A line in lower case, digits as 0, without ASCII punctuation, spaces collapsed.

    A line of punctuation alone stays as it is.
    """
    plain = b" ".join(line.lower().translate(_AS_ZERO, _PUNCTUATION).split())
    return plain or line.strip()


def repeated_words(found: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    windows = list(zip(found, found[1:], found[2:], strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    again = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    inside = np.zeros(len(found), dtype=bool)
    for shift in range(3):
        inside[shift : shift + len(windows)] |= again
    return int(inside.sum())


def base_counts(text: str) -> list[int]:
    """The base counts of a text, in the order of the result's columns."""
    data = text.encode("utf-8", "surrogatepass")
    found = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    return [len(found), chars, symbols, len(lines) - len(set(lines)), repeated_words(found)]


def line_keys(text: str) -> list[int]:
    """The different normalised lines of a text, hashed; lines without a word have none."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return list({_long(normal_line(line)) for line in set(lines) if line.strip()})


def without_lines(text: str, gone: set[int]) -> tuple[str, int]:
    """The text without the lines of these keys, and how many words went with them."""
    kept, removed = [], 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        if line.strip() and _long(normal_line(line)) in gone:
            removed += len(line.split())
        else:
            kept.append(line)
    return (b"\n".join(kept).decode("utf-8", "surrogatepass"), removed) if removed else (text, 0)


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    """Documents with their host and a key of their content; null text is an empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        text.alias("text"),
        F.xxhash64(text).alias("content"),
    )


def document_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """Stored ``(host, content, line)``: each different line of each document, hashed."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.array([line_keys(text) for text in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lines], names=["host", "content", "line"]
            )

    texts = _keyed(docs, host).select("host", "content", "text")
    found = written(texts.mapInArrow(keys, "host string, content long, line array<long>"), "lines")
    return found.select("host", "content", F.explode("line").alias("line"))


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS, max_share: float | None = None) -> DataFrame:
    """``(host, line, n_docs)`` of the lines of more than ``max_docs`` different documents of their host.

    With ``max_share`` a line of more than that share of its host's documents is frequent too,
    if it is in two or more. Documents are distinct contents: exact copies count once, so that a
    page which was fetched often is not taken for boilerplate. The limit does not grow with the
    host. The distinct count runs in two steps, by (host, line, content) and then as partial
    sums, so a line that most documents have is counted by many tasks.
    """
    counts = lines.groupBy("host", "line").agg(F.count_distinct("content").alias("n_docs"))
    if max_share is None:
        return counts.filter(F.col("n_docs") > max_docs)
    hosts = lines.groupBy(F.col("host").alias("_host")).agg(F.count_distinct("content").alias("_docs"))
    shared = (F.col("n_docs") > 1) & (F.col("n_docs") > F.lit(max_share) * F.col("_docs"))
    return (
        counts.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
        .filter((F.col("n_docs") > max_docs) | shared)
        .select("host", "line", "n_docs")
    )


def cleaned_documents(
    docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float | None = None
) -> DataFrame:
    """Each document's base counts, its ``text`` without the frequent lines of its host, and ``removed_words``.

    The lines to remove are gathered per content, of which a document has no more than lines of
    its own, and go to the texts by a join that moves no text if they were measured to fit.
    """
    lines = document_lines(docs, host)
    frequent = frequent_lines(lines, max_docs, max_share).select(
        F.col("host").alias("_host"), F.col("line").alias("_line")
    )
    on = (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host"))
    gone = lines.join(frequent, on).groupBy("_host", F.col("content").alias("_content"))
    gone = written(gone.agg(F.collect_set("line").alias("gone")), "frequent-lines")
    heavy = gone.select("_content", F.concat_ws(",", F.col("gone").cast("array<string>")).alias("_gone"))
    same = (F.col("content") == F.col("_content")) & F.col("host").eqNullSafe(F.col("_host"))
    found = _keyed(docs, host).join(hinted(gone, keys_fit(heavy, "_content", "_gone")), same, "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        held = 0
        for batch in batches:
            for doc_id, text, keys in zip(*(batch.column(at) for at in range(3)), strict=True):
                text, keys = text.as_py(), keys.as_py()
                rest, removed = without_lines(text, set(keys)) if keys else (text, 0)
                rows.append([doc_id.as_py(), *base_counts(text), removed, rest])
                held += len(rest)
                if held >= _SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays(_columns(rows), schema=_CLEANED)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(_columns(rows), schema=_CLEANED)

    return found.select("doc_id", "text", "gone").mapInArrow(clean, _CLEANED_SCHEMA)


def _columns(rows: list[list]) -> list[pa.Array]:
    return [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), _CLEANED, strict=True)]


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    max_docs: int = MAX_DOCS,
    max_share: float | None = None,
    min_words: int = MIN_WORDS,
    max_repeated: int = MAX_REPEATED,
    max_removed: int = MAX_REMOVED,
) -> DataFrame:
    """Base counts, ``removed_words``, the verdict, and the ``text`` without frequent lines of each document.

    ``base_failed`` if the text has fewer than ``min_words`` words or more than
    ``max_repeated`` per cent of them in repeated windows. ``depleted`` if the lines that
    are frequent on its host hold more than ``max_removed`` per cent of its words.
    ``kept`` if neither. Null text is an empty text; null hosts are one host; repeated
    rows are judged each; extra columns are ignored; an empty table gives no rows.
    """
    base_failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeated * F.col("n_words")
    )
    return (
        cleaned_documents(docs, host, max_docs, max_share)
        .withColumn("base_failed", base_failed)
        .withColumn("depleted", 100 * F.col("removed_words") > max_removed * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "removed_words", "depleted", "kept", "text",
        )
    )
