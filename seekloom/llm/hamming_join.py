"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Unit vectors are centred, projected to their principal directions and rotated so that their
signs lose least (iterative quantisation); thresholds at the medians balance the bits. The
code of a rotation is cut into substrings of about log2(vectors / 16) bits, each the key of a
table: vectors whose codes differ in fewer bits than there are tables share a key for certain,
others with a chance that is measured on pairs made to lie exactly at the threshold. Rotations
are added until that chance is high enough. Vectors that share a key are compared by the
Hamming distance of their first code, and what is near enough by the original vectors.

A pair is counted in the first table whose key it shares, so no list of pairs is made or
deduplicated: tasks give sums of links and the edges of a spanning forest. Exact copies are one
vector with a weight. The vectors of a key with very many are dealt to blocks, and pairs of
blocks to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekloom.llm.components import connected_components
from seekloom.plans.scratch import written
from seekloom.plans.sizing import hinted, keys_fit

FIT_ROWS = 16_384  # vectors, those of the smallest hashes, that the rotations are learned on
FIT_VALUES = 8_000_000  # and their components together
TRIAL_PAIRS = 2_000  # pairs at the threshold that the number of tables is measured with
RECALL = 0.99
CODE_BITS = 64
KEY_ROWS = 16  # vectors that share a key by chance
MAX_TABLES = 128
BLOCK = 4_096  # vectors of a key that one task compares with each other
ROUNDS = 30
_PAIRS = 400_000  # pairs that a task looks at together
_ROWS = 20_000  # rows that a task gathers before it works on their groups

_CODE_SCHEMA = "class_id long, sketch long, keys array<long>"
_NEAR_SCHEMA = "key long, class_id long"
_LINK_SCHEMA = "a long, b long, n long"


@dataclass(frozen=True)
class HammingIndex:
    """Learned rotations and the layout of the tables.

    ``planes`` has a column per bit, rotation by rotation; ``radius`` bounds the Hamming
    distance of two codes of the first rotation; ``expected`` is the share of trial pairs
    that met in a table within that distance.
    """

    planes: np.ndarray
    limits: np.ndarray
    bits: int
    key_bits: int
    tables: int
    radius: int
    expected: float

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first code and the keys of all tables, for rows of unit length."""
        per = self.bits // max(1, self.key_bits)
        bits = units @ self.planes > self.limits
        sketch = bits[:, : self.bits] @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))
        powers = np.int64(1) << np.arange(self.key_bits, dtype=np.int64)
        keys = np.empty((len(units), self.tables), dtype=np.int64)
        for table in range(self.tables):
            first = table // per * self.bits + table % per * self.key_bits
            keys[:, table] = bits[:, first : first + self.key_bits] @ powers
            keys[:, table] += np.int64(table) << np.int64(self.key_bits)
        return sketch.astype(np.uint64).view(np.int64), keys


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component goes first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _rotation(values: np.ndarray, draw: np.random.Generator, rounds: int) -> np.ndarray:
    """A rotation under which the signs of the values are nearest to the values."""
    turn = np.linalg.qr(draw.standard_normal((values.shape[1], values.shape[1])))[0]
    for _ in range(rounds):
        signs = np.where(values @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ values)
        turn = (left @ right).T
    return turn


def _trial_pairs(units: np.ndarray, cosine: float, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose cosine is the threshold: moved in any direction, and toward other vectors."""
    some = units[draw.integers(0, len(units), TRIAL_PAIRS)]
    moves = draw.standard_normal(some.shape)
    toward = units[draw.integers(0, len(units), TRIAL_PAIRS // 2)] - some[::2][: TRIAL_PAIRS // 2]
    moves[::2][: len(toward)] = toward + 1e-6 * moves[::2][: len(toward)]
    moves -= (moves * some).sum(axis=1, keepdims=True) * some
    lengths = np.linalg.norm(moves, axis=1, keepdims=True)
    moves = np.divide(moves, lengths, out=np.zeros_like(moves), where=lengths > 0)
    return some, cosine * some + math.sqrt(max(0.0, 1 - cosine * cosine)) * moves


def learn_index(
    sample: np.ndarray, rows: int, cosine: float, recall: float = RECALL, seed: int = 1
) -> HammingIndex:
    """Learn rotations on unit vectors until pairs at the threshold are found as often as asked.

    ``rows`` is the number of vectors that will be indexed; it sets the length of a key. A
    quarter of the sample is kept out of the learning for the trial pairs.
    """
    draw = np.random.default_rng(seed)
    sample = draw.permutation(sample)
    held, sample = (sample[: len(sample) // 4], sample[len(sample) // 4 :]) if len(sample) > 3 else (sample, sample)
    middle = sample.mean(axis=0)
    _, main = np.linalg.eigh(np.cov(sample.T, bias=True).reshape(sample.shape[1], -1))
    bits = min(sample.shape[1], CODE_BITS)
    main = main[:, ::-1][:, :bits]
    values = (sample - middle) @ main
    one, other = _trial_pairs(held, cosine, draw)
    key_bits = min(bits, max(8, round(math.log2(max(rows, 1) / KEY_ROWS))))
    planes, limits, radius = [], [], 0
    for key_bits in range(key_bits, 0, -1):
        per = bits // key_bits
        met = np.zeros(len(one), dtype=bool)
        for turn in range(-(-MAX_TABLES // per)):
            if turn == len(planes):
                plane = main @ _rotation(values, draw, ROUNDS)
                planes.append(plane)
                limits.append(np.median(sample @ plane, axis=0))
            differ = (one @ planes[turn] > limits[turn]) != (other @ planes[turn] > limits[turn])
            if turn == 0:
                radius = min(bits, int(differ.sum(axis=1).max()) + 1)
            for at in range(per):
                met |= ~differ[:, at * key_bits : (at + 1) * key_bits].any(axis=1)
                if met.mean() >= recall:
                    return HammingIndex(
                        np.hstack(planes[: turn + 1]), np.concatenate(limits[: turn + 1]),
                        bits, key_bits, turn * per + at + 1, radius, float(met.mean()),
                    )
    # Too few or too uniform vectors for balanced bits: one key for all.
    return HammingIndex(planes[0], limits[0], bits, 0, 1, bits, 1.0)


def _matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column filled up with zeros, and their lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return values.reshape(-1, width), lengths
    rows = np.zeros((len(lengths), width))
    rows[np.arange(width) < lengths[:, None]] = values
    return rows, lengths


def _distance(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The Hamming distance of codes held as signed integers."""
    return np.bitwise_count((one ^ other).view(np.uint64))


def _index_pairs(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers ``(i, j)`` with ``j`` in ``[first[i], last[i])``, in slices of bounded length."""
    counts = np.maximum(last - first, 0)
    sums = np.cumsum(counts)
    begin = 0
    while begin < len(counts):
        base = sums[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(sums, base + _PAIRS, side="right")))
        some = counts[begin:stop]
        if some.any():
            left = np.repeat(np.arange(begin, stop), some)
            yield left, np.arange(len(left)) + np.repeat(first[begin:stop] - (np.cumsum(some) - some), some)
        begin = stop


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by the first ``keys`` columns, many at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < _ROWS:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(rows, dtype=bool)
        for at in range(keys):
            column = table.column(at).to_numpy()
            same &= column == column[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _group_ends(columns: list[np.ndarray]) -> np.ndarray:
    """For each row of sorted rows the end of its group."""
    new = np.zeros(len(columns[0]) - 1, dtype=bool)
    for column in columns:
        new |= column[1:] != column[:-1]
    bounds = np.concatenate([np.flatnonzero(new) + 1, [len(columns[0])]])
    return np.repeat(bounds, np.diff(bounds, prepend=0))


def _joined(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Give the rows that the pairs connect the smallest label among them."""
    while True:
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while not np.array_equal(short := label[label], label):
            label[:] = short
        if np.array_equal(label[left], label[right]):
            return


def encode_vectors(classes: DataFrame, index: HammingIndex) -> DataFrame:
    """``(class_id, sketch, keys)``: the first code and the key in each table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                some = batch.slice(at, 8192)
                rows, _ = _matrix(some.column(1), len(index.planes))
                sketch, keys = index.encode(unit_rows(rows))
                offsets = pa.array(np.arange(len(keys) + 1) * index.tables, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
                names = ["class_id", "sketch", "keys"]
                yield pa.record_batch([some.column(0), pa.array(sketch), lists], names=names)

    return classes.select("class_id", "vector").mapInArrow(encode, _CODE_SCHEMA)


def _near(index: HammingIndex):
    """Rows ``(key, class_id)`` that have another one of their key within the radius."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 1):
            key, sketch = table["key"].to_numpy(), table["sketch"].to_numpy()
            hit = np.zeros(len(key), dtype=bool)
            ends = _group_ends([key])
            for left, right in _index_pairs(np.arange(1, len(key) + 1), ends):
                close = _distance(sketch[left], sketch[right]) <= index.radius
                hit[left[close]] = True
                hit[right[close]] = True
            if hit.any():
                ids = table["class_id"].to_numpy()[hit]
                yield pa.record_batch([pa.array(key[hit]), pa.array(ids)], names=["key", "class_id"])

    return near


def _links(index: HammingIndex, cosine: float):
    """Sums of links ``(a, null, n)`` and forest edges ``(a, b, 0)`` of the groups of a key and two blocks."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            key, low, high, block, ids, copies, sketch = (
                table[name].to_numpy()
                for name in ("key", "low", "high", "block", "class_id", "copies", "sketch")
            )
            count = len(key)
            ends, same = _group_ends([key, low, high]), np.arange(1, count + 1)
            # Rows are sorted by block within a group; the lower block meets the upper one.
            next_block = _group_ends([key, low, high, block])
            first = np.where(low == high, same, np.where(block == low, next_block, ends))
            keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(count, index.tables)
            rows, lengths = _matrix(table["vector"].combine_chunks(), len(index.planes))
            units = unit_rows(rows)
            number = key >> index.key_bits
            total, label = np.zeros(count, dtype=np.int64), np.arange(count)
            for left, right in _index_pairs(first, ends):
                close = _distance(sketch[left], sketch[right]) <= index.radius
                close &= lengths[left] == lengths[right]
                left, right = left[close], right[close]
                own = (keys[left] == keys[right]).argmax(axis=1) == number[left]
                left, right = left[own], right[own]
                linked = np.empty(len(left), dtype=bool)
                for at in range(0, len(left), 20_000):
                    some = slice(at, at + 20_000)
                    linked[some] = (units[left[some]] * units[right[some]]).sum(axis=1) >= cosine
                left, right = left[linked], right[linked]
                np.add.at(total, left, copies[right])
                np.add.at(total, right, copies[left])
                _joined(label, left, right)
            some, far = np.flatnonzero(total), np.flatnonzero(label != np.arange(count))
            if len(some):
                a = np.concatenate([ids[some], ids[far]])
                b = np.concatenate([np.full(len(some), -1), ids[label[far]]])
                n = np.concatenate([total[some], np.zeros(len(far), dtype=np.int64)])
                yield pa.record_batch(
                    [pa.array(a), pa.array(b, mask=b < 0), pa.array(n)], names=["a", "b", "n"]
                )

    return links


def find_links(classes: DataFrame, index: HammingIndex, cosine: float) -> DataFrame:
    """``(a, b, n)`` of the stored ``(class_id, copies, vector)``.

    Rows without ``b`` add ``n`` links to the vector ``a``; the others connect the vectors of
    the components. Codes are exchanged as narrow rows; vectors only for keys that have two
    codes within the radius.
    """
    codes = written(encode_vectors(classes, index), "codes")
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = codes.select("class_id", "sketch", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").count().filter(F.col("count") > BLOCK)
    blocks = F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")
    hot = written(sizes.select(F.col("key").alias("_key"), blocks), "hot-keys")
    fits = keys_fit(hot, "_key")
    usual = rows.join(hinted(hot, fits), F.col("key") == F.col("_key"), "left_anti")
    usual = usual.select("key", "class_id", "sketch").repartition(width, "key")
    near = usual.sortWithinPartitions("key").mapInArrow(_near(index), _NEAR_SCHEMA)
    zero = F.lit(0).alias
    near = near.select("key", "class_id", zero("low"), zero("high"), zero("block"))
    crowded = rows.join(hinted(hot, fits), F.col("key") == F.col("_key"))
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    crowded = crowded.select("key", "class_id", "blocks", block.alias("block"))
    crowded = crowded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    crowded = crowded.select(
        "key", "class_id", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block",
    )
    whole = classes.select("class_id", "copies", "vector").join(codes, "class_id")
    groups = near.unionByName(crowded).join(whole, "class_id")
    dealt = groups.repartition(width, "key", "low", "high").sortWithinPartitions("key", "low", "high", "block")
    dealt = dealt.select(
        "key", "low", "high", "block", "class_id", "copies", "sketch", "keys", "vector"
    )
    return dealt.mapInArrow(_links(index, cosine), _LINK_SCHEMA)


def distinct_vectors(frame: DataFrame) -> DataFrame:
    """``(class_id, least, copies, vector, h1, h2)`` of the different vectors among ``(vec_id, vector, h1, h2)``."""
    groups = frame.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
    )
    return written(groups.withColumn("class_id", F.monotonically_increasing_id()), "vectors")


def fit_index(classes: DataFrame, cosine: float, recall: float = RECALL, seed: int = 1) -> HammingIndex:
    """Learn the rotations on a bounded sample of the stored vectors, chosen by hash."""
    size = classes.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("width")).first()
    take = max(64, min(FIT_ROWS, FIT_VALUES // size["width"]))
    sample = classes.orderBy(F.xxhash64("h1", "h2"), "class_id").limit(take).select("vector").toArrow()
    rows, _ = _matrix(sample.column(0).combine_chunks(), size["width"])
    return learn_index(unit_rows(rows), size["rows"], cosine, recall, seed)


def near_duplicate_vectors(
    vectors: DataFrame,
    cosine: float = 0.95,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    recall: float = RECALL,
    seed: int = 1,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each vector.

    ``n_links`` counts the other vectors whose cosine was found to reach the threshold, exact
    copies among them; ``component_id`` is the smallest id that links reach, and ``kept``
    says whether it is the vector's own. No pair below the threshold is linked; a pair at the
    threshold is found with a chance of about ``recall``, nearer ones with a higher one.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with
    nothing, nor do vectors of different lengths with each other; rows of a null id link
    with nothing and are kept with a null component. Rows that share an id are a vector each.
    Other columns are ignored; an empty table gives no rows.
    """
    value = F.col(vector).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(vec_id).isNotNull() & value.isNotNull() & finite & F.exists(value, lambda x: x != 0)
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.when(F.coalesce(usable, F.lit(False)), value).alias("vector"),
    )
    rows = rows.select(
        "vec_id", "vector",
        F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("h1"),
        F.xxhash64(F.size("vector"), F.reverse("vector")).alias("h2"),
    )
    classes = distinct_vectors(rows.filter("vector IS NOT NULL"))
    ids = rows.drop("vector")
    if classes.isEmpty():
        found = ids.withColumn("links", F.lit(None).cast("long")).withColumn("first", F.lit(None).cast("long"))
    else:
        links = written(find_links(classes, fit_index(classes, cosine, recall, seed), cosine), "vector-links")
        counts = links.groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n"))
        stars = written(connected_components(links.filter("b IS NOT NULL"), "a", "b"), "vector-stars")
        slim = classes.drop("vector")
        least = (
            stars.join(slim, F.col("node") == F.col("class_id"))
            .groupBy("component")
            .agg(F.min("least").alias("first"))
        )
        firsts = stars.join(least, "component").select(F.col("node").alias("class_id"), "first")
        linked = slim.join(counts, "class_id", "left").join(firsts, "class_id", "left")
        linked = linked.filter((F.col("copies") > 1) | F.col("first").isNotNull())
        linked = linked.select(
            F.col("h1").alias("_h1"),
            F.col("h2").alias("_h2"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"),
            F.coalesce("first", "least").alias("first"),
        )
        linked = written(linked, "linked-vectors")
        same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
        found = ids.join(hinted(linked, keys_fit(linked, "_h1", "_h2")), same, "left")
    component = F.coalesce("first", "vec_id")
    return found.select(
        "vec_id",
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
