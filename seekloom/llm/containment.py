"""Benchmark decontamination with DataFrame functions only.

Short test items are searched inside long documents by MinHash. Jaccard similarity of a
short and a long set is small however much of the short one is contained, so documents
are partitioned by size, and the number of one-permutation bins grows with the partition:
the bins are so many that a bin of a document holds few shingles, and a shingle that an
item has too is the bin's minimum often enough. An item is sketched with the bins of each
partition. Equal minima give candidates; their shingle sets are then compared exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekloom.llm.copies import only_ids, text_key
from seekloom.llm.mixing import WORD
from seekloom.plans.scratch import written
from seekloom.plans.sizing import hinted, keys_fit

SHINGLE_WORDS = 5
PERCENT = 75
MISS = 1e-5  # chance that an item that just meets the threshold has no equal minimum


def with_shingles(frame: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``shingles``, the sorted distinct hashes of the 5-word shingles of a text.

    Words are lower-cased; fewer than five are one shingle together, none give none. The
    words are a column of their own, so that the shingles' expression does not cut them
    anew for each position. For the same reason the result must not be filtered by its
    shingles before it is exploded or stored: the condition would move below that column.
    """
    gaps = SHINGLE_WORDS - 1
    cut = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    words = F.col("_words")
    count = F.size(words)
    each = F.transform(
        F.slice(words, F.lit(1), F.greatest(count - gaps, F.lit(0))),
        lambda word, at: F.xxhash64(word, *(F.get(words, at + shift) for shift in range(1, SHINGLE_WORDS))),
    )
    whole = F.when(count > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    found = F.sort_array(F.array_distinct(F.when(count > gaps, each).otherwise(whole)))
    return frame.select(*keep, cut.alias("_words")).select(*keep, found.alias("shingles"))


def bin_load(n_item: int, percent: int, miss: float) -> float:
    """Shingles a bin of a document may hold so that an item of this size is hardly missed.

    With a load of x, a shingle is the minimum of its bin with chance (1 - exp(-x)) / x.
    An item at the threshold shares ``n_item * percent / 100`` shingles, each with its own
    chance; all fail together with the chance ``miss``.
    """
    shared = max(1, math.ceil(n_item * percent / 100))
    wanted = 1 - miss ** (1 / shared)
    low, high = 1e-6, 8.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 - math.exp(-mid)) / mid > wanted else (low, mid)
    return low


def minima(shingles: str, bits: Column) -> Column:
    """The smallest hash in each of ``2 ** bits`` equal ranges of sorted hashes.

    The first of the sorted hashes in a range is its minimum, so the sketch is a filter
    over neighbours.
    """
    held = F.col(shingles)

    def bin_of(value: Column) -> Column:
        return F.expr("shiftright")(value) if False else F.call_function("shiftright", value, 64 - bits)

    return F.filter(held, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(held, i - 1))))


def contained_items(
    docs: DataFrame, items: DataFrame, percent: int = PERCENT, miss: float = MISS
) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item)`` of items that documents contain.

    An item is contained if a document has at least ``percent`` of its distinct 5-word
    shingles. An item of fewer words is one shingle, which only a text of just these words
    has. Items or documents without a word, without text or without id are in no row;
    documents that share an id and a text are one; extra columns are ignored; an empty
    table on either side gives no rows.
    """
    own = with_shingles(
        items.filter(F.col("item_id").isNotNull()).select("item_id", F.col("text").alias("_text")),
        "_text",
        ["item_id"],
    )
    own = written(own.select("item_id", "shingles", F.size("shingles").alias("n_item")), "items")
    own = own.filter("n_item > 0")
    smallest = own.agg(F.min("n_item").alias("n")).first()["n"] or 1
    load = bin_load(smallest, percent, miss)
    # The bits of a size partition: enough bins for the load at the partition's upper end.
    extra = math.ceil(-math.log2(load)) if load < 1 else -math.floor(math.log2(load))
    bits = F.greatest(F.lit(1), F.least(F.lit(40), F.ceil(F.log2(F.greatest(F.size("shingles"), F.lit(1)))) + extra)).cast("int")
    keyed = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").alias("_text")
    )
    sets = with_shingles(keyed, "_text", ["doc_id", "text_key"])
    sketches = sets.withColumn("bits", bits).select(
        "doc_id", "text_key", "bits", F.explode(minima("shingles", F.col("bits"))).alias("low")
    )
    widths = F.explode(F.sequence(F.lit(1), F.lit(40)))
    item_minima = own.withColumn("bits", widths).select(
        "item_id", "bits", F.explode(minima("shingles", F.col("bits"))).alias("low")
    )
    item_minima = written(item_minima, "item_minima")
    fits = keys_fit(item_minima, "item_id", "bits", "low")
    candidates = written(
        sketches.join(hinted(item_minima, fits), ["bits", "low"])
        .select("doc_id", "text_key", "item_id")
        .distinct(),
        "candidates",
    )
    texts = only_ids(keyed, written(candidates.select("doc_id").distinct(), "ids"))
    found = with_shingles(texts, "_text", ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    of_item = own.select("item_id", "n_item", F.col("shingles").alias("item_shingles"))
    shared = F.size(F.array_intersect("shingles", "item_shingles"))
    return (
        candidates.join(found, ["doc_id", "text_key"])
        .join(of_item, "item_id")
        .select("doc_id", "item_id", shared.cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"))
        .filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    )
