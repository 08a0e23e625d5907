"""Periodic runs of words, found by recursive frequency splitting.

A run is a stretch of words with a smallest period q and at least ``max(6, 4 q)`` words that
its neighbours do not extend. Each of its words stands in it four times or more. A word that
occurs less often within a segment is thus in no run of the segment and splits it; what is
left is counted and split again until no word is too rare. Of the pieces of a split only the
smaller ones are counted afresh and taken off the counts of the largest, so that a text of n
words costs n log n however deep the recursion goes.

The surviving segments are scanned for lags. Windows of 1, 2, 4, ... words are named, equal
windows alike, and the lag of a place is the distance to the next place of its segment with
the same window. Inside a run of period q the next place of a window of q or more words is
exactly q words on. So a stretch of places of equal lag q, under the first window size that is
not below q, is a run, word for word and without any candidate to verify. Windows that do
not recur are left out of the next size. All is computed within a text; no rows are exchanged.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_REPEATS = 4
MIN_WORDS = 6

_SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())]
)
_SLICE_BYTES = 8 * 1024 * 1024  # texts put together before a batch is handed on

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def surviving_segments(
    words: list, repeats: int = MIN_REPEATS, least: int = MIN_WORDS
) -> list[tuple[int, int]]:
    """Stretches ``[low, high)`` of at least ``least`` words in which every word occurs ``repeats`` times."""
    places: dict = {}
    for at, word in enumerate(words):
        places.setdefault(word, []).append(at)
    counts = {word: len(found) for word, found in places.items()}
    rare = [word for word, count in counts.items() if count < repeats]
    kept, work = [], [(0, len(words), counts, rare)]
    while work:
        low, high, counts, rare = work.pop()
        if high - low < least:
            continue
        cuts = []
        for word in rare:
            found = places[word]
            first = bisect_left(found, low)
            cuts += found[first : first + counts.pop(word)]
        if not cuts:
            kept.append((low, high))
            continue
        cuts.sort()
        pieces = [(a + 1, b) for a, b in zip([low - 1, *cuts], [*cuts, high], strict=True) if b - a > 1]
        largest = max(pieces, key=lambda piece: piece[1] - piece[0], default=None)
        touched = set()
        for piece in pieces:
            if piece == largest:
                continue
            fresh = Counter(words[piece[0] : piece[1]])
            for word, count in fresh.items():
                counts[word] -= count
            touched.update(fresh)
            if piece[1] - piece[0] >= least:
                work.append((*piece, fresh, [word for word, n in fresh.items() if n < repeats]))
        if largest:
            work.append((*largest, counts, [word for word in touched if counts[word] < repeats]))
    return sorted(kept)


def _next_same(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the distance to the next one of the same name (0: none), and if it recurs at all."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    lags = np.zeros(len(names), dtype=np.int64)
    lags[order[:-1][same]] = (places[order[1:]] - places[order[:-1]])[same]
    recurs = np.zeros(len(names), dtype=bool)
    recurs[order[1:][same]] = True
    recurs[order[:-1][same]] = True
    return lags, recurs


def lag_scan(
    segments: list[tuple[int, int]], words: list, repeats: int = MIN_REPEATS, least: int = MIN_WORDS
) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs within the segments, by start and then period."""
    if not segments:
        return []
    ids: dict = {}
    numbers = np.fromiter(
        (ids.setdefault(word, len(ids)) for low, high in segments for word in words[low:high]), np.int64
    )
    lows = np.array([low for low, _ in segments], dtype=np.int64)
    sizes = np.array([high - low for low, high in segments], dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    places = np.arange(len(numbers)) + np.repeat(lows - offsets, sizes)
    ends = np.repeat(lows + sizes, sizes)
    # Windows of different segments never are the same: a name starts with its segment.
    names = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(ids) + numbers, return_inverse=True)[1]
    longest, width, runs = int(sizes.max()), 1, []
    while len(places) and (width // 2 + 1) * repeats <= longest:
        lags, recurs = _next_same(names, places)
        edge = np.flatnonzero((np.diff(lags) != 0) | (np.diff(places) != 1)) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [len(lags)]]) - 1
        lag = lags[first]
        length = places[last] - places[first] + width + lag
        good = (lag > width // 2) & (lag <= width) & (length >= np.maximum(least, repeats * lag))
        runs += zip(places[first][good].tolist(), length[good].tolist(), lag[good].tolist(), strict=True)
        # The name of a window twice as wide: those of its halves.
        places, ends, names = places[recurs], ends[recurs], names[recurs]
        other = np.searchsorted(places, places + width)
        there = np.minimum(other, max(len(places) - 1, 0))
        whole = (places + 2 * width <= ends) & (other < len(places))
        whole &= places[there] == places + width
        halves = names[whole] * (len(numbers) + 1) + names[there[whole]]
        names = np.unique(halves, return_inverse=True)[1]
        places, ends, width = places[whole], ends[whole], 2 * width
    return sorted(runs, key=lambda run: (run[0], run[2]))


def find_runs(words: list, repeats: int = MIN_REPEATS, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of at least ``max(least, repeats * period)`` words."""
    return lag_scan(surviving_segments(words, repeats, least), words, repeats, least)


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    kept, at = [], 0
    for first, end in sorted((start + period, start + length) for start, length, period in runs):
        if first > at:
            kept += words[at:first]
        at = max(at, end)
    return kept + words[at:]


def collapse_runs(
    docs: DataFrame,
    rewrite: Rewrite | None = None,
    repeats: int = MIN_REPEATS,
    least: int = MIN_WORDS,
) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: the runs of each text, and the text with one period of each.

    Words are runs of characters other than space and U+0009 to U+000D; ``collapsed`` joins
    the words that stay by one space. ``rewrite`` may change the words of a text before the
    search, given its id and its words. ``repeats`` is at least 4, else a window need not recur
    inside a run. Null and empty texts have no words and no runs; a null id stays null; repeated
    rows are judged each; other columns are ignored; an empty table gives no rows. A text is
    worked on as a whole, in memory proportional to its length.
    """
    if repeats < 4:
        raise ValueError("a run must hold its period four times or more")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                if rewrite:
                    words = rewrite(doc_id, words)
                runs = find_runs(words, repeats, least)
                collapsed = b" ".join(without_repeats(words, runs))
                rows.append((doc_id, len(words), runs, collapsed))
                held += len(collapsed)
                if held >= _SLICE_BYTES:
                    yield _packed(rows)
                    rows, held = [], 0
        if rows:
            yield _packed(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(search, _SCHEMA)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    ids, counts, runs, collapsed = zip(*rows, strict=True)
    flat = [run for found in runs for run in found]
    offsets = np.cumsum([0, *map(len, runs)])
    columns = [pa.array([run[at] for run in flat], pa.int64()) for at in range(3)]
    lists = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN))
    )
    arrays = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.binary())]
    return pa.record_batch(arrays, schema=_ARROW)


def run_digests(found: DataFrame) -> DataFrame:
    """Per document its number of runs, the longest one and digests of the runs and of the collapsed text.

    Of runs of equal length the one with the smallest start, then period, is the longest;
    without runs its columns are null.
    """
    ranked = F.transform(
        "runs", lambda run: F.struct(run["length"], -run["start"], -run["period"])
    )
    top = F.array_max(ranked)
    lines = F.transform(
        "runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        top.alias("_top"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_words",
        "n_runs",
        (-F.col("_top")["col2"]).alias("start"),
        F.col("_top")["length"].alias("length"),
        (-F.col("_top")["col3"]).alias("period"),
        F.floor(1000 * F.col("_top")["length"] / -F.col("_top")["col3"]).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
