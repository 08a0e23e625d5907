from __future__ import annotations

import random

import numpy as np
from xxhash import xxh3_64_intdigest

from seekloom.llm import cotraining
from tests.llm.conftest import rows_by_id

BAD = ["idiot", "trash", "scum"]


def corpus(count, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("an", "er", "ing", "on", "at", "ou")]
    rows, labels = [], []
    for doc_id in range(count):
        found = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        good = 1
        if doc_id % 5 == 0:
            good = 0
            found = [word + rng.choice(["%%%", "###"]) for word in found]
        elif doc_id % 7 == 0:
            good = 0
            for _ in range(4):
                found[rng.randrange(len(found))] = rng.choice(BAD)
        rows.append((doc_id, " ".join(found), f"src{doc_id % 3}"))
        labels.append((doc_id, good))
    return rows, labels


def test_held_out_accuracy_and_bounds(spark, make_docs):
    rows, labels = corpus(900)
    extra = [(5000, None), (5001, ""), (None, "words without an id"), (5002, rows[1][1]), (5002, rows[1][1])]
    known = spark.createDataFrame([x for x in labels if x[0] < 500] + [(None, 1), (7, None)], "doc_id long, good int")
    scored = cotraining.quality_scores(make_docs(rows + extra), known, max_labelled=400)
    found = rows_by_id(scored)
    assert scored.count() == len(rows) + len(extra)
    right = [found[doc_id]["kept"] == bool(good) for doc_id, good in labels if doc_id >= 500]
    assert sum(right) >= 0.95 * len(right)
    clean = [found[doc_id]["kept"] for doc_id, good in labels if doc_id >= 500 and good]
    assert sum(clean) >= 0.97 * len(clean)
    again = rows_by_id(cotraining.quality_scores(make_docs(rows + extra), known, max_labelled=400))
    assert all(found[key]["score"] == again[key]["score"] for key in found)
    assert all(0.0 <= row["score"] <= 1.0 for row in found.values())


def test_pseudo_labels_reach_both_views(spark, make_docs):
    rows, labels = corpus(600)
    known = spark.createDataFrame(labels[:80], "doc_id long, good int")
    alone = cotraining.fit(make_docs(rows), known, rounds=0)
    taught = cotraining.fit(make_docs(rows), known, rounds=3)
    assert (alone.text.weights != taught.text.weights).any()
    assert (alone.meta.weights != taught.meta.weights).any()


def test_one_class_and_empty_tables(spark, make_docs):
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, good int")
    docs = make_docs([(1, "a b"), (2, None), (3, "c")])
    assert [row["kept"] for row in cotraining.quality_scores(docs, one).collect()] == [True] * 3
    assert cotraining.quality_scores(docs, one.limit(0)).count() == 3
    assert cotraining.quality_scores(make_docs([]), one).count() == 0


def test_good_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int")
    found = {row["doc_id"]: row["good"] for row in cotraining.good_labels(labels).collect()}
    assert found == {1: 1, 2: 0, 3: 0, 4: 1, 5: None}


def plain_scores(rows, labels):
    """Scores by id from co-training without Spark: features, bins and draws over Python rows."""
    known = dict(labels)
    text_of = {doc_id: (text, source) for doc_id, text, source in rows}

    def buckets(text, source):
        text = text or ""
        return cotraining.text_features(text), cotraining.meta_features(text, "en", source)

    ids = sorted(set(known) & set(text_of))
    found = [buckets(*text_of[doc_id]) for doc_id in ids]
    sizes = (cotraining.TEXT_BUCKETS, cotraining.META_BUCKETS)
    features = [([pair[view] for pair in found], sizes[view]) for view in range(2)]
    good = np.array([float(known[doc_id]) for doc_id in ids])
    held = np.array([xxh3_64_intdigest(b"%d" % at) % 1000 < 1000 * cotraining.HELD_OUT for at in ids])
    columns = cotraining.telling_columns(features, good, held)
    pool = {}
    for doc_id, text, source in rows:
        if doc_id not in known:
            pair = buckets(text, source)
            kept = tuple(row[np.isin(row, own)] for row, own in zip(pair, columns))
            pool[tuple(map(tuple, kept))] = kept

    def draw(views, share, turn):
        out = []
        for at, view in enumerate(views):
            logits = {key: view.logit(kept[at]) for key, kept in pool.items()}
            order = sorted(logits, key=logits.get)
            quota = max(2, int(cotraining.CONFIDENT * len(order)))
            n_bad = max(1, round(quota * (1 - share)))
            low = [key for key in order if logits[key] < 0]
            high = [key for key in reversed(order) if logits[key] >= 0]
            for label, side, wanted in ((0.0, low, n_bad), (1.0, high, max(1, quota - n_bad))):
                if not side:
                    continue
                # The bin of the last row wanted counts whole; log-odds beyond 30 share a bin.
                place = {key: np.floor(min(max(logits[key], -30.0), 30.0) * cotraining.BINS) for key in side}
                last = place[side[:wanted][-1]]
                sure = [key for key in side if (place[key] >= last if label else place[key] <= last)]
                out += [(at, hash(key), label, pool[key]) for key in sure]
        return out

    model = cotraining.co_train(features, columns, good, held, draw)
    return {doc_id: model.score(*buckets(*text_of[doc_id]))[0] for doc_id in text_of}


def test_equals_plain_co_training(spark, make_docs):
    rows, labels = corpus(700, seed=5)
    labels = labels[:250]
    copies = [(9000 + i, rows[600][1], rows[600][2]) for i in range(40)]  # alike ones count once
    known = spark.createDataFrame(labels, "doc_id long, good int")
    found = rows_by_id(cotraining.quality_scores(make_docs(rows + copies), known))
    wanted = plain_scores(rows + copies, labels)
    assert found.keys() == wanted.keys()
    assert max(abs(found[key]["score"] - wanted[key]) for key in wanted) < 1e-6


def test_draws_reach_all_unlabelled_rows_in_bounds():
    rng = np.random.default_rng(3)
    bins = np.sort(cotraining.logit_bins(rng.normal(0, 2, 200_000)))
    values, counts = np.unique(bins, return_counts=True)
    cuts = cotraining.confident_bins(dict(zip(values.tolist(), counts.tolist())), 0.75)
    label = cotraining.drawn(rng.integers(0, 1 << 62, len(bins)), bins, cuts, 0)
    assert 0.7 * cotraining.TAUGHT <= (label >= 0).sum() <= 1.3 * cotraining.TAUGHT
    assert bins[label == 0].max() < 0 <= bins[label == 1].min()
    # Not only the most extreme rows, but any that are sure enough.
    assert np.median(bins[label == 1]) < np.quantile(bins, 0.99)


def test_several_texts_of_an_id_and_very_long_texts(spark, make_docs):
    rows, labels = corpus(300, seed=8)
    extra = [(1, "one more text of a labelled id"), (7000, "w " * 400_000), (7001, "x" * 1_000_000)]
    known = spark.createDataFrame(labels[:200], "doc_id long, good int")
    one = cotraining.quality_scores(make_docs(rows + extra), known).collect()
    two = cotraining.quality_scores(make_docs(extra + rows[::-1]).repartition(5), known).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 303
