"""Set-similarity join of texts by universe partition and the pigeonhole principle.

Two sets of sizes x and y that meet the threshold differ in at most D elements. The
universe of shingles is cut by hash into m segments, the same ones for all sets of a size
band; D differences touch at most D segments, so similar sets agree on the others. Every
set costs its units where they are cheap: a segment's subset is indexed as it is (one
unit, one row). Segments that are empty, or whose subset is held by many sets, would cost
long lists and are not used; a set that is left with D units or fewer is indexed anew
with half as many, larger segments, each as its subset and all subsets with one element
deleted (two units each). Long lists are left out there too; the sets that run short again
are those of large groups of near copies, whose lists are all long. These are compared
with one set of each list, then with others if the list is not one component, and what
is left is paired across components, unless sketches of the sets rule a pair out. A pair is found in the first index unless both sets ran short there, then in
the second unless both ran short again, so nothing is lost. Candidates must share as many
units as similar sets do, and are then verified exactly.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekloom.llm.components import connected_components
from seekloom.llm.copies import find_copies, only_ids, text_key, without_copies
from seekloom.llm.hashing import mix, shingle_set, signed
from seekloom.plans.scratch import written

PERCENT = 75
LEADS = 3  # sets of a split list that are compared with all of it before all pairs are
LONG_LIST = 12  # sets that share a subset, beyond which it is no unit of the first index
_OWN, _UPPER, _SIZE = 0, 1, 2
_PAIR, _LONG, _MEASURE = 0, 1, 2
SKETCH_WORDS = 8  # 64-bit words of a set's sketch
LONG_SKETCH = 32  # words of the sketches by which the pairs are looked at again
EARLIER = 24  # whole subsets before a list's own segment in which a pair may have been made already
_SET_BYTES = 2 * 1024 * 1024  # of sets that are handed on together
_TEXTS = 256  # texts that a worker holds as strings at once
_INDEX_ROWS = 100_000  # rows of the first index that are handed on together, about
_SALT = np.uint64(0x9E3779B97F4A7C15)
_INDEX_SCHEMA = "sig long, doc_id long, code int, n int, spare int"
_FOUND_SCHEMA = "kind int, a long, b long, code int, x int, y int"


@functools.lru_cache(maxsize=4096)
def band_start(band: int, percent: int) -> int:
    """The smallest size in a band; a band spans twice the ratio that similar sizes may have."""
    size = 1
    for _ in range(band):
        size = max(size + 1, math.ceil(size * (100 / percent) ** 2))
    return size


@functools.lru_cache(maxsize=65536)
def band_of(size: int, percent: int) -> int:
    """The band of a set size."""
    band = 0
    while band_start(band + 1, percent) <= size:
        band += 1
    return band


def most_different(total: int, percent: int) -> int:
    """How many elements two similar sets with so many elements together can differ in."""
    return total * (100 - percent) // (100 + percent)


def allowance(size: int, band: int, percent: int) -> int | None:
    """The differences a set must reckon with in the index of a band, None if it isn't in it.

    A band's index holds the pairs whose smaller set is in the band.
    """
    if band == band_of(size, percent):
        return most_different(size + size * 100 // percent, percent)
    below = band_start(band + 1, percent) - 1
    if size > below and size * percent <= below * 100:
        return most_different(size + below, percent)
    return None


@functools.lru_cache(maxsize=4096)
def segments(band: int, percent: int) -> int:
    """Segments of a band: the fewest that leave sets of every size a margin of units.

    A segment costs each set a row, so fewer is cheaper; but the fewer there are, the less
    is left of the units when some segments are empty or have long lists.
    """
    low, high = band_start(band, percent), band_start(band + 1, percent)
    sizes = [low, high - 1, high, (high - 1) * 100 // percent]
    needs = [(s, d) for s in sizes if (d := allowance(s, band, percent)) is not None]

    def margin(m: int) -> bool:
        for size, differ in needs:
            empty = math.exp(-size / m)
            used = m * (1 - empty) - 1.5 * math.sqrt(m * empty * (1 - empty))
            if used < 1.03 * (differ + 1) + 0.01 * size:
                return False
        return True

    first = max(d for _, d in needs) + 1
    return next((m for m in range(first, 4 * first + 4) if margin(m)), 2 * first)


def _cut(found: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments that a sorted set has elements in, and where each starts."""
    at = ((found >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[starts], starts


def _named(sums: np.ndarray, segment: np.ndarray, salt: int) -> np.ndarray:
    return mix(sums + mix(segment + np.uint64(salt * int(_SALT) % (1 << 64))))


def subset_rows(found: np.ndarray, percent: int) -> list[tuple[np.ndarray, int, int]]:
    """For each band a set is indexed in: its subsets' signatures, the code, the spare units."""
    size, rows = len(found), []
    own, values = band_of(size, percent), mix(found + _SALT)
    for band, kind in ((own, _OWN), (own - 1, _UPPER)):
        differ = allowance(size, band, percent) if band >= 0 else None
        if differ is None:
            continue
        segment, starts = _cut(found, segments(band, percent))
        sums = np.add.reduceat(values, starts)
        rows.append((_named(sums, segment, band + 1), band * 4 + kind, len(starts) - differ - 1))
    return rows


def double_segments(band: int, percent: int) -> int:
    """Segments of a band in the second index, where each is worth two units."""
    high = band_start(band + 1, percent) - 1
    return most_different(high + high * 100 // percent, percent) // 2 + 1


def neighbourhood_rows(
    found: np.ndarray, band: int, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set's subsets and one-deletion subsets in the second index of a band.

    With them the segment of each, and whether an element was deleted.
    """
    count = double_segments(band, percent)
    at = ((found >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    values, salt = mix(found + _SALT), (1 << 20) + band
    sums = np.zeros(count, dtype=np.uint64)
    np.add.at(sums, at, values)
    every = np.arange(count, dtype=np.uint64)
    whole, less = _named(sums, every, salt), _named(sums[at] - values, at, salt)
    deleted = np.concatenate([np.zeros(count, bool), np.ones(len(found), bool)])
    return np.concatenate([whole, less]), np.concatenate([every, at]).astype(np.int32), deleted


def subset_index(texts: DataFrame, percent: int) -> DataFrame:
    """Rows of the first index, and a row with the size of each set under its text's key."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sig", "doc_id", "code", "n", "spare"]
        kinds = [np.int64, np.int32, np.int32, np.int32]
        for batch in (batch.slice(at, _TEXTS) for batch in batches for at in range(0, batch.num_rows, _TEXTS)):
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts: list[tuple] = []
            held = 0
            for at, text in enumerate(batch.column(2).to_pylist()):
                found = shingle_set(text)
                size, short = len(found), 0
                rows = subset_rows(found, percent) if size else []
                for sigs, code, spare in rows:
                    # 48 bits tell subsets apart; two that meet by chance only lengthen a list.
                    parts.append((signed(sigs >> np.uint64(16)), ids[at], code, size, spare))
                    held += len(sigs)
                    short |= (spare < 0) << (code % 4)
                band = band_of(size, percent) if size else 0
                parts.append((np.array([keys[at]], np.int64), ids[at], band * 4 + _SIZE, size, short))
                held += 1
                if held >= _INDEX_ROWS or at + 1 == len(ids):
                    counts = [len(part[0]) for part in parts]
                    sigs = np.concatenate([part[0] for part in parts])
                    rest = [
                        np.repeat(np.array([part[c] for part in parts], kind), counts)
                        for c, kind in enumerate(kinds, 1)
                    ]
                    yield pa.record_batch([pa.array(column) for column in (sigs, *rest)], names=names)
                    parts, held = [], 0

    return texts.select("doc_id", "text_key", "text").mapInArrow(index, _INDEX_SCHEMA)


def _short_pairs(rows: dict, starts: np.ndarray, sizes: np.ndarray, percent: int, long_list: int):
    """All pairs within the groups of each length that is not long."""
    for length in range(2, long_list + 1):
        first = starts[sizes == length]
        if not len(first):
            continue
        left, right = np.triu_indices(length, 1)
        x = (first[:, None] + left[None, :]).ravel()
        y = (first[:, None] + right[None, :]).ravel()
        upper = (rows["code"][x] % 4 == _UPPER) & (rows["code"][y] % 4 == _UPPER)
        small = np.minimum(rows["n"][x], rows["n"][y])
        large = np.maximum(rows["n"][x], rows["n"][y])
        fits = ~upper & (large * percent <= small * 100) & (rows["doc_id"][x] != rows["doc_id"][y])
        x, y = x[fits], y[fits]
        swap = rows["doc_id"][x] > rows["doc_id"][y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        total = rows["n"][x] + rows["n"][y]
        differ = total * (100 - percent) // (100 + percent)
        yield x, y, rows["used"][x] - differ, rows["used"][y] - differ


def subset_candidates(index: DataFrame, percent: int, long_list: int = LONG_LIST) -> DataFrame:
    """Pairs in short lists, members of long lists and sizes, from the index sorted by signature.

    A run of equal signatures is held until it is known to be long; the members of a long
    run leave as they come, so memory does not depend on the length of a list.
    """

    schema = pa.schema(
        [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]
        + [(name, pa.int32()) for name in ("code", "x", "y")]
    )

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[str, np.ndarray] | None = None
        long_sig = None

        def allowed(code: np.ndarray, n: np.ndarray) -> np.ndarray:
            below = np.array([band_start(b + 1, percent) - 1 for b in range(60)], dtype=np.int64)
            most = np.where(code % 4 == _OWN, n * 100 // percent, below[np.minimum(code // 4, 59)])
            return (n + most) * (100 - percent) // (100 + percent)

        def table(kind: int, a, b, code, x, y) -> pa.RecordBatch:
            columns = np.broadcast_arrays(kind, a, b, code, x, y)
            arrays = [
                pa.array(np.ascontiguousarray(column, dtype=field.type.to_pandas_dtype()))
                for column, field in zip(columns, schema, strict=True)
            ]
            return pa.record_batch(arrays, schema=schema)

        def flush(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            change = rows["sig"][1:] != rows["sig"][:-1]
            starts = np.flatnonzero(np.concatenate([[True], change]))
            sizes = np.diff(np.concatenate([starts, [len(rows["sig"])]]))
            rows["used"] = rows["spare"] + allowed(rows["code"], rows["n"]) + 1
            for x, y, need_x, need_y in _short_pairs(rows, starts, sizes, percent, long_list):
                band = np.minimum(rows["code"][x], rows["code"][y]) // 4
                yield table(_PAIR, rows["doc_id"][x], rows["doc_id"][y], band, need_x, need_y)
            heavy = np.repeat(sizes > long_list, sizes)
            if heavy.any():
                yield long_rows({name: column[heavy] for name, column in rows.items()})

        def long_rows(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            return table(_LONG, rows["doc_id"], 0, rows["code"], rows["spare"], 0)

        for batch in batches:
            rows = {
                name: batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
                for at, name in enumerate(batch.schema.names)
            }
            size = rows["code"] % 4 == _SIZE
            if size.any():
                yield table(
                    _MEASURE, rows["doc_id"][size], rows["sig"][size], rows["code"][size],
                    rows["n"][size], rows["spare"][size],
                )
                rows = {name: column[~size] for name, column in rows.items()}
            if not len(rows["sig"]):
                continue
            if long_sig is not None:
                same = rows["sig"] == long_sig
                if same.any():
                    yield long_rows({name: column[same] for name, column in rows.items()})
                if same.all():
                    continue
                rows = {name: column[~same] for name, column in rows.items()}
                long_sig = None
            if carry is not None:
                rows = {name: np.concatenate([carry[name], rows[name]]) for name in rows}
            last = int(np.flatnonzero(rows["sig"] == rows["sig"][-1])[0])
            carry = {name: column[last:] for name, column in rows.items()}
            if last:
                yield from flush({name: column[:last] for name, column in rows.items()})
            if len(carry["sig"]) > long_list:
                yield long_rows(carry)
                long_sig, carry = int(carry["sig"][0]), None
        if carry is not None:
            yield from flush(carry)

    return index.repartition("sig").sortWithinPartitions("sig").mapInArrow(found, _FOUND_SCHEMA)


def neighbourhood_index(texts: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """The second index of the sets in ``short`` (doc_id, bands).

    ``segment`` and ``deleted`` say what a signature stands for; ``m`` is the number of
    segments of the band and ``differ`` the differences the set must reckon with there.
    """
    schema = "sig long, doc_id long, band int, segment int, deleted boolean, n int, m int, differ int"
    names = [part.split()[0] for part in schema.split(", ")]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(at).to_pylist() for at in range(3)), strict=True)
            for doc_id, text, bands in rows:
                found = shingle_set(text)
                for band in bands:
                    differ = allowance(len(found), band, percent) if len(found) else None
                    if differ is None:
                        continue
                    sigs, segment, deleted = neighbourhood_rows(found, band, percent)
                    fixed = (len(found), double_segments(band, percent), differ)
                    size = len(sigs)
                    arrays = [
                        pa.array(signed(sigs)), pa.array(np.full(size, doc_id, np.int64)),
                        pa.array(np.full(size, band, np.int32)), pa.array(segment), pa.array(deleted),
                        *(pa.array(np.full(size, value, np.int32)) for value in fixed),
                    ]
                    yield pa.record_batch(arrays, names=names)

    joined = only_ids(texts, short).join(short, "doc_id").select("doc_id", "text", "bands")
    return joined.mapInArrow(index, schema)


def _shared_units(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of the sets in each list, with the units that they share.

    An equal subset is two units, one with one element more or less is one.
    """
    columns = [name for name in lists.columns if name != "sig"]
    left = lists.select("sig", *(F.col(name).alias(f"{name}_a") for name in columns))
    right = lists.select("sig", *(F.col(name).alias(f"{name}_b") for name in columns))
    pairs = left.join(right, "sig").filter(
        (F.col("doc_id_a") < F.col("doc_id_b"))
        & ~(F.col("deleted_a") & F.col("deleted_b"))
        & _like("n_a", "n_b", percent)
    )
    units = F.when(F.col("deleted_a") | F.col("deleted_b"), 1).otherwise(2)
    total = F.first("n_a") + F.first("n_b")
    differ = F.floor(total * (100 - percent) / (100 + percent))
    return pairs.groupBy(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), F.col("band_a").alias("band")).agg(
        F.sum(units).alias("units"), (2 * F.first("m_a") - differ).alias("need")
    )


def _like(n: str, m: str, percent: int) -> Column:
    """Whether sets of two sizes can be similar."""
    return F.greatest(n, m) * percent <= F.least(n, m) * 100


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``(doc_id, held)``: the sorted hashes of each text's set, 8 bytes each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                held.append(shingle_set(text.as_py()).tobytes())
                size += len(held[-1])
                if size >= _SET_BYTES:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "held"])
                    ids, held, size = [], [], 0
            if ids:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "held"])

    return texts.select("doc_id", "text").mapInArrow(sets, "doc_id long, held binary")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets meet the threshold.

    A text's set is made once and joined to its pairs; a pair is looked at where its two sets
    lie in the batch, so that a task holds no copies of them. Sets are carried to their pairs
    only where sketches do not show yet that they differ too much.
    """
    pairs = written(pairs.select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sets = written(shingle_sets(only_ids(texts, written(ids.distinct(), "ids"))), "sets")
    pairs = written(likely_pairs(pairs, sets, percent), "likely")
    # Sets that are left in no pair are not carried at all.
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sets = only_ids(sets, written(ids.distinct(), "likely-ids"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("held").alias("held_b"))
    first = sets.select(F.col("doc_id").alias("a"), F.col("held").alias("held_a"))
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "held_a", "held_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(side.as_buffer(), np.uint64) for side in (one, other))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"]
            )

    return written(joined.mapInArrow(check, "a long, b long"), "links")


def parity_sketches(texts: DataFrame, words: int = SKETCH_WORDS) -> DataFrame:
    """``(doc_id, s0, s1, ...)``: the sketches of the texts' sets."""
    # In one step with the sets: two steps would take two workers a task.
    return _sketched(texts.select("doc_id", "text"), words, lambda text: shingle_set(text.as_py())).drop("n")


def set_sketches(sets: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n, s0, s1, ...)``: the sketches of stored sets, and their sizes."""
    return _sketched(sets.select("doc_id", "held"), words, lambda held: np.frombuffer(held.as_buffer(), np.uint64))


def _sketched(rows: DataFrame, words: int, values_of: Callable[[pa.Scalar], np.ndarray]) -> DataFrame:
    """Which of ``64 * words`` places an odd number of the hashes of each row's set fall on.

    Two sets' sketches differ in no more places than the sets differ in elements.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = np.zeros((batch.num_rows, words), dtype=np.uint64), np.zeros(batch.num_rows, np.int32)
            for row, held in enumerate(batch.column(1)):
                values = values_of(held)
                sizes[row] = len(values)
                places = np.bincount((mix(values) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words)
                found[row] = np.packbits((places & 1).astype(np.uint8), bitorder="little").view(np.uint64)
            columns = [pa.array(signed(np.ascontiguousarray(found[:, at]))) for at in range(words)]
            yield pa.record_batch([batch.column(0), pa.array(sizes), *columns], names=["doc_id", "n", *names])

    names = [f"s{at}" for at in range(words)]
    schema = ", ".join(["doc_id long", "n int", *(f"{name} long" for name in names)])
    return rows.mapInArrow(sketch, schema)


def _may_be_similar(words: int, percent: int) -> Column:
    """Whether no more places of two sketches differ than similar sets of their sizes have unlike elements."""
    differ = (F.bit_count(F.col(f"s{at}_a").bitwiseXOR(F.col(f"s{at}_b"))) for at in range(words))
    return sum(differ, F.lit(0)) <= F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))


def likely_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that long sketches of their sets do not rule out."""
    sketches = written(set_sketches(sets, LONG_SKETCH), "pair-sketches")
    for side in ("b", "a"):
        own = _sided(sketches, side).withColumnRenamed(f"doc_id_{side}", side)
        pairs = pairs.join(own, side)
    likely = _like("n_a", "n_b", percent) & _may_be_similar(LONG_SKETCH, percent)
    return pairs.filter(likely).select("a", "b").distinct()


def _sided(frame: DataFrame, side: str) -> DataFrame:
    """The frame with a side's name on all columns but ``sig``."""
    return frame.select(*(F.col(name).alias(name if name == "sig" else f"{name}_{side}") for name in frame.columns))


def list_pairs(lists: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``(doc_id_a, doc_id_b, n_a, n_b)`` of sets that share a list, lie in different parts and may be similar.

    Sets that share one list mostly share many. A list leaves a pair out if the two also share the
    one of the last ``EARLIER`` whole subsets before its own segment: that list has made the pair, or
    in turn leaves it to an earlier one, so none is lost. A pair can still come more than once.
    """
    # Rows of one id with different sizes are of different texts.
    own = ("doc_id", "n", "band")
    latest = Window.partitionBy(*own, "deleted").orderBy("segment").rowsBetween(1 - EARLIER, 0)
    before = Window.partitionBy(*own).orderBy("segment").rangeBetween(Window.unboundedPreceding, -1)
    wholes = lists.withColumn("wholes", F.when(~F.col("deleted"), F.collect_list("sig").over(latest)))
    earlier = F.coalesce(F.last("wholes", ignorenulls=True).over(before), F.array().cast("array<long>"))
    held = wholes.select("sig", "doc_id", "n", "deleted", "part", earlier.alias("earlier"))
    held = written(held, "held").join(written(parity_sketches(texts), "sketches"), "doc_id")
    pairs = _sided(held, "a").join(_sided(held, "b"), "sig").filter(
        (F.col("doc_id_a") < F.col("doc_id_b"))
        & (F.col("part_a") != F.col("part_b"))
        & ~(F.col("deleted_a") & F.col("deleted_b"))
        & _like("n_a", "n_b", percent)
        & _may_be_similar(SKETCH_WORDS, percent)
        & ~F.arrays_overlap("earlier_a", "earlier_b")
    )
    return pairs.select("doc_id_a", "doc_id_b", "n_a", "n_b")


def pairs_across(lists: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of sets that share a list of ``lists``, lie in different parts and may be similar.

    Sketches, short ones in the join and then long ones, leave out pairs whose sets differ too much.
    """
    pairs = list_pairs(lists, texts, percent).distinct()
    long = written(parity_sketches(texts, LONG_SKETCH), "long-sketches")
    for side in ("a", "b"):
        pairs = pairs.join(_sided(long, side), f"doc_id_{side}")
    pairs = pairs.filter(_may_be_similar(LONG_SKETCH, percent))
    return pairs.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def _first_pairs(found: DataFrame) -> DataFrame:
    """Candidates of the first index that share as many subsets as similar sets must.

    Two similar sets agree on all but D of the segments that either uses; those of them
    that have long lists are not counted, so they are taken off what is asked for.
    """
    long_lists = found.filter(F.col("kind") == _LONG).groupBy(F.col("a").alias("doc")).agg(
        F.count(F.lit(1)).alias("h")
    )
    pairs = found.filter(F.col("kind") == _PAIR).groupBy("a", "b", "code").agg(
        F.count(F.lit(1)).alias("shared"), F.max("x").alias("need_a"), F.max("y").alias("need_b")
    )
    for side in ("a", "b"):
        own = long_lists.select(F.col("doc").alias(side), F.col("h").alias(f"h_{side}"))
        pairs = pairs.join(own, side, "left")
    zero = F.lit(0)
    need = F.greatest(
        F.col("need_a") - F.coalesce("h_a", zero), F.col("need_b") - F.coalesce("h_b", zero)
    )
    return pairs.filter(F.col("shared") >= need).select("a", "b").distinct()


def _short_sets(found: DataFrame) -> DataFrame:
    """``(doc_id, bands)`` of the sets that run short of units in a band's first index."""
    listed = found.filter(F.col("kind") == _LONG).groupBy("a", "code").agg(
        F.count(F.lit(1)).alias("h"), F.min("x").alias("spare")
    )
    listed = listed.filter(F.col("spare") < F.col("h")).select("a", F.expr("code div 4").alias("band"))
    sizes = found.filter((F.col("kind") == _MEASURE) & (F.col("y") > 0))
    own = F.expr("code div 4")
    bands = F.array(F.when(F.expr("y & 1") > 0, own), F.when(F.expr("y & 2") > 0, own - 1))
    empty = sizes.select("a", F.explode(bands).alias("band")).filter(F.col("band").isNotNull())
    short = listed.unionByName(empty).groupBy(F.col("a").alias("doc_id"))
    return written(short.agg(F.collect_set(F.col("band").cast("int")).alias("bands")), "short")


def _second_pairs(lists: DataFrame, percent: int, long_list: int) -> tuple[DataFrame, DataFrame]:
    """Candidates from the short lists of the second index, and the sets that ran short.

    A segment any of whose lists is long is not counted on, nor is it asked for.
    """
    lost = written(
        lists.filter(F.col("listed") > long_list)
        .groupBy("doc_id", "band")
        .agg(
            F.count_distinct("segment").alias("lost"), F.first("m").alias("m"), F.first("differ").alias("differ")
        ),
        "lost",
    )
    pairs = _shared_units(lists.filter(F.col("listed") <= long_list).drop("listed"), percent)
    for side in ("a", "b"):
        own = lost.select(F.col("doc_id").alias(side), "band", F.col("lost").alias(f"lost_{side}"))
        pairs = pairs.join(own, [side, "band"], "left")
    zero = F.lit(0).cast("long")
    fewer = F.least(F.coalesce("lost_a", zero), F.coalesce("lost_b", zero))
    pairs = pairs.filter(F.col("units") >= F.col("need") - 2 * fewer).select("a", "b").distinct()
    return pairs, lost.filter(2 * (F.col("m") - F.col("lost")) <= F.col("differ")).select("doc_id", "band")


def similar_links(
    texts: DataFrame, percent: int = PERCENT, long_list: int = LONG_LIST
) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, enough to connect all similar ones; and set sizes.

    ``texts`` has one row per text.
    """
    candidates = subset_candidates(subset_index(texts, percent), percent, long_list)
    found = written(candidates, "found")
    sizes = found.filter(F.col("kind") == _MEASURE).select(
        F.col("a").alias("doc_id"), F.col("b").alias("text_key"), F.col("x").alias("n_shingles")
    )
    by_sig = Window.partitionBy("sig")
    lists = neighbourhood_index(texts, _short_sets(found), percent)
    lists = (
        lists.withColumn("low", F.min("doc_id").over(by_sig))
        .withColumn("high", F.max("doc_id").over(by_sig))
        .withColumn("no_whole", F.min("deleted").over(by_sig))
        .withColumn("listed", F.count(F.lit(1)).over(by_sig))
        .filter(~F.col("no_whole") & (F.col("low") != F.col("high")))
        .drop("low", "high", "no_whole")
    )
    lists = written(lists, "lists")
    pairs, shorter = _second_pairs(lists, percent, long_list)
    shorter = written(shorter, "shorter")
    hard = written(lists.drop("listed").join(shorter, ["doc_id", "band"], "left_semi"), "hard")
    lead = hard.groupBy("sig").agg(F.min(F.struct("doc_id", "n")).alias("lead"))
    stars = hard.join(lead, "sig").filter(
        (F.col("lead.doc_id") < F.col("doc_id")) & _like("n", "lead.n", percent)
    )
    stars = stars.select(F.col("lead.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    tried = written(_first_pairs(found).unionByName(pairs).unionByName(stars).distinct(), "tried")
    links = verified(tried, texts, percent)
    placed = _split_lists(hard, links)
    if not placed.isEmpty():
        # More leads, the same ones in all lists that they are in.
        order = ("doc_id", "n", "part")
        leads = [F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), *order)) for turn in range(1, LEADS + 1)]
        lead = placed.groupBy("sig").agg(F.array(*leads).alias("leads")).select("sig", F.explode("leads").alias("lead"))
        other = (F.col("lead.part") != F.col("part")) & _like("n", "lead.n", percent)
        pairs = placed.join(lead, "sig").filter(other).select(
            F.least("lead.doc_id", "doc_id").alias("a"), F.greatest("lead.doc_id", "doc_id").alias("b")
        )
        pairs = written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "led")
        tried = tried.unionByName(pairs)
        more = verified(pairs, texts, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            placed = _split_lists(hard, links)
    few = written(placed.select("doc_id").distinct(), "split-ids")
    across = pairs_across(placed, only_ids(texts, few), percent).join(tried, ["a", "b"], "left_anti")
    return links.unionByName(verified(across, texts, percent)), sizes


def _split_lists(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists whose sets are not one component of the links yet, with each set's ``part``."""
    parts = connected_components(links, "a", "b")
    placed = lists.join(parts, F.col("doc_id") == F.col("node"), "left").withColumn(
        "part", F.coalesce("component", "doc_id")
    )
    split = placed.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    split = split.filter("low != high").select("sig")
    return written(placed.join(split, "sig").drop("node", "component"), "split")


def jaccard_classes(
    docs: DataFrame, percent: int = PERCENT, long_list: int = LONG_LIST
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs``.

    A text's set holds its distinct 5-word shingles, A-Z in lower case; with fewer words
    the whole sequence is one; without a word the set is empty and linked with nothing.
    Documents whose sets meet the threshold are linked; ``component_id`` is the smallest
    id reachable by links. Exact copies are linked through the copy with the smallest id.

    Null or empty text gives size 0 and the document's own id. Rows with the same id are
    one document for linking and keep their own sizes. A row without id is linked with
    nothing and has no component. Extra columns are ignored; an empty table gives no rows.
    """
    copies = find_copies(docs)
    texts = without_copies(docs, copies)
    links, sizes = similar_links(texts, percent, long_list)
    parts = connected_components(links, "a", "b").withColumnRenamed("node", "_node")
    sizes = sizes.distinct().select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_shingles"
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    rows = own.join(copies, ["doc_id", "text_key"], "left").withColumn(
        "rep", F.coalesce("rep", "doc_id")
    )
    # A document with several texts is linked with the representative of each.
    several = rows.groupBy(F.col("doc_id").alias("b")).agg(F.min("rep").alias("l"), F.max("rep").alias("h"))
    several = several.filter(F.col("l") != F.col("h")).select("b")
    joins = written(
        rows.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).join(several, "b").select("a", "b"),
        "same_id",
    )
    if not joins.isEmpty():
        parts = connected_components(links.unionByName(joins), "a", "b").withColumnRenamed("node", "_node")
    return (
        rows.join(sizes, (F.col("rep") == F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
        .join(parts, F.col("rep") == F.col("_node"), "left")
        .select(
            "doc_id",
            F.coalesce(F.col("n_shingles").cast("long"), F.lit(0).cast("long")).alias("n_shingles"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
