"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from seekloom.llm.hashing import mix
from seekloom.plans.scratch import written
from seekloom.plans.sizing import hinted, keys_fit

MAX_LABELLED = 10000  # labelled documents that the classifiers are fitted on, at most
ROUNDS = 3
CONFIDENT = 0.1  # share of the unlabelled documents that a view is sure enough of in a round
TAUGHT = 600  # pseudo-labels that are drawn from those for the other view, about
BINS, MOST_BIN = 16, 480  # steps of log-odds that confidence is counted in, and the last one
HELD_OUT = 0.25
THRESHOLD = 0.5
TEXT_BUCKETS, META_BUCKETS = 1 << 18, 1 << 12
MIN_SHARE = 0.003  # documents of the sample that must have a feature, as a share
MIN_EVIDENCE = 3.0  # standard errors by which a word's share must differ between the classes
_SPACES = " \t\n\r\x0b\x0c"


def _hashed(names: list[bytes], buckets: int) -> np.ndarray:
    values = np.fromiter(map(xxh3_64_intdigest, names), np.uint64, len(names))
    return np.unique(values % np.uint64(buckets)).astype(np.int64)


def _level(value: float, steps: float) -> int:
    return min(40, int(value * steps))


def text_features(text: str) -> np.ndarray:
    """Buckets of the words and of how repetitive the wording is."""
    data = text.encode("utf-8", "surrogatepass").lower()
    found = data.split()
    distinct = set(found)
    names = [word.strip(b".,;:!?\"'()") for word in distinct]
    if found:
        same = sum(a == b for a, b in zip(found, found[1:], strict=False))
        names.append(b"\x00again %d" % _level(same / len(found), 20))
        marks = sum(not word[-1:].isalnum() and word[-1] < 128 for word in distinct)
        names.append(b"\x00marks %d" % _level(marks / len(distinct), 10))
    return _hashed(names, TEXT_BUCKETS)


def meta_features(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Buckets of a page's language, source, size and layout."""
    size = len(text)
    names = [f"lang {lang}", f"source {source}", f"size {size.bit_length()}"]
    lines = text.count("\n") + 1
    names.append(f"lines {lines.bit_length()}")
    names.append(f"line size {int(2 * np.log2(1 + size / lines))}")
    if size:
        letters = text.encode("utf-8", "surrogatepass")
        upper = size - len(letters.translate(None, bytes(range(65, 91)))) if text.isascii() else sum(map(str.isupper, text))
        symbols = sum(map(text.count, "#*$%&|<>!={}[]"))
        names.append(f"upper {_level(upper / size, 40)}")
        names.append(f"symbols {_level(symbols / size, 80)}")
        names.append(f"digits {_level(sum(map(text.count, '0123456789')) / size, 80)}")
        names.append(f"spaces {_level(sum(map(text.count, _SPACES)) / size, 40)}")
    return _hashed([name.encode() for name in names], META_BUCKETS)


@dataclass(frozen=True)
class View:
    """A fitted view: a weight for each bucket, a bias, and the scale and shift of its logits."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def logit(self, buckets: np.ndarray) -> float:
        """Calibrated log-odds that a document is good."""
        return self.scale * (self.bias + float(self.weights[buckets].sum())) + self.shift


@dataclass(frozen=True)
class CoTrained:
    """Both calibrated views and how much each counts."""

    text: View
    meta: View
    mixing: tuple[float, float, float]

    def score(self, text_buckets: np.ndarray, meta_buckets: np.ndarray) -> tuple[float, float, float]:
        """Probability that a document is good, by both views and by each alone."""
        one, two = self.text.logit(text_buckets), self.meta.logit(meta_buckets)
        a, b, c = self.mixing
        return _sigmoid(a * one + b * two + c), _sigmoid(one), _sigmoid(two)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


class _Rows:
    """Sparse rows of ones, restricted to buckets that enough rows have."""

    def __init__(self, rows: list[np.ndarray], buckets: int, columns: np.ndarray | None = None) -> None:
        counts = np.array([len(row) for row in rows], dtype=np.int64)
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), counts)
        if columns is None:
            least = max(3, int(np.ceil(MIN_SHARE * len(rows))))
            columns = np.flatnonzero(np.bincount(flat, minlength=buckets) >= least)
        place = np.full(buckets, -1, dtype=np.int64)
        place[columns] = np.arange(len(columns))
        flat = place[flat]
        self.columns, self.size = columns, len(rows)
        self.owner, self.flat = owner[flat >= 0], flat[flat >= 0]

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.owner, weights=weights[self.flat], minlength=self.size) + bias

    def gradient(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, weights=errors[self.owner], minlength=len(self.columns))


def _telling(rows: _Rows, good: np.ndarray) -> np.ndarray:
    """The columns whose share among good rows and among others differs beyond chance."""
    n_good, n_bad = good.sum(), len(good) - good.sum()
    in_good, in_bad = rows.gradient(good), rows.gradient(1 - good)
    share = (in_good + in_bad) / len(good)
    error = np.sqrt(share * (1 - share) * (1 / n_good + 1 / n_bad)) + 1e-12
    return rows.columns[np.abs(in_good / n_good - in_bad / n_bad) >= MIN_EVIDENCE * error]


def _fit(rows: _Rows, good: np.ndarray, importance: np.ndarray, steps: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty, by Adam over all rows."""
    weights, bias = np.zeros(len(rows.columns)), 0.0
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    total = max(importance.sum(), 1.0)
    for step in range(1, steps + 1):
        errors = (_sigmoid(rows.logits(weights, bias)) - good) * importance / total
        gradient = np.append(rows.gradient(errors) + 1e-4 * weights, errors.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def _dense_fit(columns: np.ndarray, good: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression on a few dense columns and a constant, by damped Newton steps."""
    table = np.column_stack([columns, np.ones(len(columns))])
    weights = np.zeros(table.shape[1])
    # Platt's targets keep a separable sample from giving infinite weights.
    n_good, n_bad = good.sum(), len(good) - good.sum()
    target = np.where(good > 0, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    for _ in range(steps):
        chance = _sigmoid(table @ weights)
        gradient = table.T @ (chance - target) + 1e-3 * weights
        hessian = (table.T * (chance * (1 - chance))) @ table + 1e-2 * np.eye(len(weights))
        weights = weights - np.linalg.solve(hessian, gradient)
    return weights


def telling_columns(
    features: list[tuple[list[np.ndarray], int]], good: np.ndarray, held: np.ndarray
) -> list[np.ndarray]:
    """The buckets of either view that the training labels show to tell the classes apart."""
    train = np.flatnonzero(~held)
    return [_telling(_Rows([rows[at] for at in train], buckets), good[train]) for rows, buckets in features]


def confident_bins(counts: dict[int, int], share: float) -> list[tuple[int, float]]:
    """For bad and for good rows the bin up to, or from, which a view is sure, and the share drawn.

    ``counts`` has the unlabelled rows of each bin of log-odds. Of both classes together
    CONFIDENT of all rows are taken, in the proportion of the labels; the bin in which a
    class has enough counts whole, and no bin of the other sign does.
    """
    quota = max(2, int(CONFIDENT * sum(counts.values())))
    n_bad = max(1, round(quota * (1 - share)))
    found = []
    for wanted, bins, part in (
        (n_bad, sorted(at for at in counts if at < 0), 1 - share),
        (max(1, quota - n_bad), sorted((at for at in counts if at >= 0), reverse=True), share),
    ):
        taken, cut = 0, None
        for at in bins:
            if taken < wanted:
                taken, cut = taken + counts[at], at
        found.append((cut, min(1.0, max(1.0, TAUGHT * part) / taken) if taken else 0.0))
    return found


def logit_bins(logits: np.ndarray) -> np.ndarray:
    """The bins of log-odds that confidence is counted in."""
    return np.clip(np.floor(logits * BINS), -MOST_BIN, MOST_BIN).astype(np.int64)


def drawn(keys: np.ndarray, bins: np.ndarray, cuts: list[tuple[int, float]], turn: int) -> np.ndarray:
    """1 or 0 for the rows that are drawn as good or bad ones, by a hash of their key, else -1."""
    unit = (mix(keys.astype(np.uint64) + np.uint64(turn)) >> np.uint64(11)) / 2.0**53
    label = np.full(len(keys), -1, dtype=np.int64)
    for value, (cut, rate) in enumerate(cuts):
        if cut is not None:
            sure = bins >= cut if value else bins <= cut
            label[sure & (unit < rate)] = value
    return label


Taught = tuple[int, int, float, tuple[np.ndarray, np.ndarray]]  # view, key, label, buckets of both views


def co_train(
    features: list[tuple[list[np.ndarray], int]],
    columns: list[np.ndarray],
    good: np.ndarray,
    held: np.ndarray,
    draw: Callable[[list[View], float, int], list[Taught]],
    rounds: int = ROUNDS,
) -> CoTrained:
    """Fit two views that label each other's training rows.

    ``features`` has the bucket rows and the number of buckets of either view, ``good``
    their labels. In a round each view is fitted on the labels and on what the other one
    labelled; ``draw`` then gives rows without a label that a view is sure of. Pseudo-labels
    count half. The rows in ``held`` are never trained on; they calibrate each view and
    their mix.
    """
    train, test = np.flatnonzero(~held), np.flatnonzero(held)
    share = float(good[train].mean())
    given: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]
    fitted: list[View] = []
    for turn in range(rounds + 1):
        fitted = []
        for view, (rows, buckets) in enumerate(features):
            taught = [given[view][key] for key in sorted(given[view])]
            own = [rows[at] for at in train] + [row for _, row in taught]
            target = np.concatenate([good[train], [label for label, _ in taught]])
            importance = np.concatenate([np.ones(len(train)), np.full(len(taught), 0.5)])
            weights, bias = _fit(_Rows(own, buckets, columns[view]), target, importance)
            full = np.zeros(buckets)
            full[columns[view]] = weights
            fitted.append(View(full, float(bias)))
        if turn < rounds:
            for view, key, label, found in draw(fitted, share, turn):
                given[1 - view][key] = (label, found[1 - view])
    truth, calibrated, done = good[test], [], []
    for (rows, _), view in zip(features, fitted, strict=True):
        logits = np.array([view.logit(rows[at]) for at in test])
        scale, shift = _dense_fit(logits[:, None], truth)
        calibrated.append(scale * logits + shift)
        done.append(View(view.weights, view.bias, float(scale), float(shift)))
    a, b, c = _dense_fit(np.column_stack(calibrated), truth)
    return CoTrained(done[0], done[1], (float(a), float(b), float(c)))


def _featured(docs: DataFrame, extra: str, columns: list[np.ndarray] | None = None) -> DataFrame:
    """``doc_id``, the field ``extra`` (name and type, or none) and the buckets of both views.

    Only buckets in ``columns`` are kept, if given.
    """
    names = ["doc_id", *extra.split()[:1], "text_buckets", "meta_buckets"]
    masks = None
    if columns is not None:
        masks = [np.zeros(size, dtype=bool) for size in (TEXT_BUCKETS, META_BUCKETS)]
        for mask, own in zip(masks, columns, strict=True):
            mask[own] = True

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            found: list[list[np.ndarray]] = [[], []]
            for text, lang, source in zip(*(batch.column(at) for at in range(-3, 0)), strict=True):
                text = text.as_py() or ""
                pair = text_features(text), meta_features(text, lang.as_py(), source.as_py())
                for view, row in enumerate(pair):
                    found[view].append((row if masks is None else row[masks[view][row]]).astype(np.int32))
            kept = [batch.column(at) for at in range(batch.num_columns - 3)]
            yield pa.record_batch([*kept, *(pa.array(rows, kind) for rows in found)], names=names)

    fields = ["doc_id long", *([extra] if extra else []), "text_buckets array<int>", "meta_buckets array<int>"]
    return docs.select(*names[:-2], "text", "lang", "source").mapInArrow(features, ", ".join(fields))


def _logits(rows: pa.ListArray, view: View) -> np.ndarray:
    """Uncalibrated log-odds of rows of buckets."""
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False))
    return view.bias + np.bincount(owner, weights=view.weights[flat], minlength=len(rows))


def _draw_from(pool: DataFrame) -> Callable[[list[View], float, int], list[Taught]]:
    """Draws from the stored table ``(key, text_buckets, meta_buckets)`` of all unlabelled documents.

    All rows are scored and counted by their bins, at most 2 * MOST_BIN + 1 for a view; a
    second pass keeps some of the sure rows, about TAUGHT for a view however large the pool.
    """

    def draw(views: list[View], share: float, turn: int) -> list[Taught]:
        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 2 * MOST_BIN + 1), dtype=np.int64)
            for batch in batches:
                for at, view in enumerate(views):
                    bins = logit_bins(_logits(batch.column(1 + at), view))
                    total[at] += np.bincount(bins + MOST_BIN, minlength=total.shape[1])
            view, bins = np.nonzero(total)
            yield pa.record_batch(
                [pa.array(view), pa.array(bins - MOST_BIN), pa.array(total[view, bins])], names=["view", "bin", "n"]
            )

        counts: list[dict[int, int]] = [{}, {}]
        sums = pool.mapInArrow(counted, "view long, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n"))
        for row in sums.collect():
            counts[row["view"]][row["bin"]] = row["n"]
        cuts = [confident_bins(one, share) for one in counts]

        def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                for at, view in enumerate(views):
                    label = drawn(keys, logit_bins(_logits(batch.column(1 + at), view)), cuts[at], turn)
                    kept = batch.filter(pa.array(label >= 0))
                    head = [pa.array(np.full(kept.num_rows, at)), pa.array(label[label >= 0])]
                    yield pa.record_batch([*head, *kept.columns], names=["view", "label", *batch.schema.names])

        schema = "view long, label long, key long, text_buckets array<int>, meta_buckets array<int>"
        rows = pool.mapInArrow(sure, schema).toArrow().sort_by([("view", "ascending"), ("key", "ascending")])
        return [
            (row["view"], row["key"], float(row["label"]), tuple(
                np.array(row[name], dtype=np.int64) for name in ("text_buckets", "meta_buckets")
            ))
            for row in rows.to_pylist()
        ]

    return draw


def _fitted(
    docs: DataFrame, labels: DataFrame, max_labelled: int, rounds: int
) -> tuple[CoTrained | None, DataFrame | None]:
    """The model, and the stored buckets of every row of ``docs``."""
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("good").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("good").cast("double").alias("good"))
    known = written(known, "labels")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    ids = own.select("doc_id").join(hinted(known, keys_fit(known, "doc_id")), "doc_id").distinct()
    chosen = written(ids.orderBy(order, "doc_id").limit(max_labelled), "sample")
    sample = own.join(hinted(chosen, keys_fit(chosen, "doc_id")), "doc_id")
    # Of several texts with one id that of the smallest hash counts.
    text = F.struct(F.xxhash64("text", "lang", "source").alias("h"), "text", "lang", "source")
    sample = sample.groupBy("doc_id", "good").agg(F.min(text).alias("row")).select("doc_id", "good", "row.*")
    rows = _featured(sample, "good double").orderBy("doc_id").toArrow()
    good = np.array(rows.column("good").to_pylist(), dtype=np.float64)
    held = np.array([xxh3_64_intdigest(b"%d" % at) % 1000 < 1000 * HELD_OUT for at in rows.column("doc_id").to_pylist()], bool)
    for part in (held, ~held):
        if not part.any() or good[part].min() == good[part].max():
            return None, None
    features = []
    for name, buckets in (("text_buckets", TEXT_BUCKETS), ("meta_buckets", META_BUCKETS)):
        features.append(([np.array(row, dtype=np.int64) for row in rows.column(name).to_pylist()], buckets))
    columns = telling_columns(features, good, held)
    stored = written(_featured(own, "", columns), "buckets")
    pool = stored.join(hinted(known.select("doc_id"), keys_fit(known, "doc_id")), "doc_id", "left_anti")
    pool = pool.select("text_buckets", "meta_buckets").distinct()
    pool = written(pool.select(F.xxhash64("text_buckets", "meta_buckets").alias("key"), "*"), "pool")
    return co_train(features, columns, good, held, _draw_from(pool), rounds), stored


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS
) -> CoTrained | None:
    """Co-train on a bounded sample of labelled rows and on all rows without a label.

    ``labels`` has doc_id and ``good`` (1 or 0). The labelled sample is that of the smallest
    hashes of doc_id, the same in each run. In every round all other documents are scored,
    of which alike ones count once, and each view's pseudo-labels are drawn from those it is
    sure of. None if the labels do not hold both classes. A document with several labels is
    good if all are; of several texts with one id that of the smallest hash is trained on.
    """
    return _fitted(docs, labels, max_labelled, rounds)[0]


def score(stored: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, text_score, meta_score, kept)`` of stored rows of buckets."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "score", "text_score", "meta_score"]
        a, b, c = model.mixing
        for batch in batches:
            one, two = (
                view.scale * _logits(batch.column(1 + at), view) + view.shift
                for at, view in enumerate((model.text, model.meta))
            )
            parts = [_sigmoid(a * one + b * two + c), _sigmoid(one), _sigmoid(two)]
            yield pa.record_batch([batch.column(0), *map(pa.array, parts)], names=names)

    schema = "doc_id long, score double, text_score double, meta_score double"
    found = stored.select("doc_id", "text_buckets", "meta_buckets").mapInArrow(scores, schema)
    return found.withColumn("kept", F.col("score") >= threshold)


def kept_documents(docs: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns."""
    if model is None:
        return docs

    # Texts become strings one at a time: a worker holds no batch of them.
    @F.arrow_udf("double")
    def own(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
        rows = ((t.as_py() or "", l.as_py(), s.as_py()) for t, l, s in zip(text, lang, source, strict=True))
        return pa.array(
            [model.score(text_features(t), meta_features(t, l, s))[0] for t, l, s in rows], pa.float64()
        )

    return docs.filter(own("text", "lang", "source") >= threshold)


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """Co-train on ``labels`` (doc_id, good) and score all of ``docs``.

    Null text is scored as an empty text, null languages and sources as values of their
    own; repeated rows get equal scores; extra columns are ignored. Without labels of both
    classes every document has score 1 and is kept; an empty table gives no rows.
    """
    model, stored = _fitted(docs, labels, max_labelled, ROUNDS)
    if model is not None:
        return score(stored, model, threshold)
    ones = [F.lit(1.0).alias(name) for name in ("score", "text_score", "meta_score")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *ones, F.lit(True).alias("kept"))


def good_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, good)``: good if the quality label is 1 and the toxicity label is not."""
    clean = F.col("quality") * (1 - F.coalesce(F.col("toxic"), F.lit(0)))
    return labels.select("doc_id", clean.alias("good"))
