from __future__ import annotations

import random

import numpy as np
import pytest

from seekloom.llm import jaccard_join
from seekloom.llm.components import connected_components
from tests.llm.brute import Union, jaccard_components, shingles

VOCABULARY = [f"w{i}" for i in range(400)]


def edited(rng, text, edits):
    found = text.split()
    for _ in range(edits):
        at = rng.randrange(len(found))
        kind = rng.randrange(3)
        if kind == 0:
            found[at] = rng.choice(VOCABULARY)
        elif kind == 1:
            found.insert(at, rng.choice(VOCABULARY))
        elif len(found) > 1:
            del found[at]
    return " ".join(found)


def corpus(seed):
    rng = random.Random(seed)
    line = " ".join(rng.choice(VOCABULARY) for _ in range(14))
    rows = []
    for _ in range(45):
        base = " ".join(rng.choice(VOCABULARY) for _ in range(int(5 * 1.5 ** rng.uniform(0, 9))))
        if rng.random() < 0.4:
            base = f"{line}\n{base}"
        rows.append(base)
        rows += [edited(rng, base, rng.randrange(1, 2 + len(base.split()) // 30)) for _ in range(rng.randrange(4))]
    centre = " ".join(rng.choice(VOCABULARY) for _ in range(150))
    rows += [edited(rng, centre, rng.randrange(4)) for _ in range(40)]
    rows += [rows[0]] * 5 + [rows[3].upper(), "one", "ONE", "two words", "", None, " \n", "a b c d", "a b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("long_list", [1, 4, 12])
def test_classes_equal_brute_force(make_docs, long_list):
    rows = corpus(long_list)
    found = jaccard_join.jaccard_classes(make_docs(rows), long_list=long_list).collect()
    assert sorted(tuple(row) for row in found) == sorted(jaccard_components(rows))


def test_other_threshold(make_docs):
    rows = corpus(99)
    found = jaccard_join.jaccard_classes(make_docs(rows), percent=85, long_list=3).collect()
    assert sorted(tuple(row) for row in found) == sorted(jaccard_components(rows, 85))


def test_empty_null_and_repeated_ids(make_docs):
    assert jaccard_join.jaccard_classes(make_docs([])).count() == 0
    text, other = "a b c d e f g h", "x y z u v w q r"
    rows = [(1, None), (2, text), (3, text), (3, other), (4, other), (None, other), (5, text), (5, text)]
    found = sorted(
        (tuple(row) for row in jaccard_join.jaccard_classes(make_docs(rows)).collect()),
        key=repr,
    )
    assert found == sorted(
        [(1, 0, 1), (2, 4, 2), (3, 4, 2), (3, 4, 2), (4, 4, 2), (5, 4, 2), (5, 4, 2), (None, 0, None)],
        key=repr,
    )


@pytest.mark.parametrize("percent", [75, 90])
def test_pigeonhole_holds_for_every_pair(percent):
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 4, 7, 20, 63, 64, 65, 200, 900):
        one = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for _ in range(60):
            most = jaccard_join.most_different(2 * size, percent)
            cut, added = rng.integers(0, most + 1, 2)
            other = np.unique(np.concatenate([one[: size - cut], rng.integers(0, 1 << 63, added, dtype=np.uint64)]))
            if not len(other):
                continue
            both = len(np.intersect1d(one, other))
            if 100 * both < percent * (len(one) + len(other) - both):
                continue
            rows = [{code // 4: (set(sigs.tolist()), spare) for sigs, code, spare in jaccard_join.subset_rows(s, percent)} for s in (one, other)]
            band = min(map(lambda s: jaccard_join.band_of(len(s), percent), (one, other)))
            shared = rows[0][band][0] & rows[1][band][0]
            assert shared or (rows[0][band][1] < 0 and rows[1][band][1] < 0)
            second = [jaccard_join.neighbourhood_rows(s, band, percent) for s in (one, other)]
            whole = [set(sigs[~deleted].tolist()) for sigs, _, deleted in second]
            less = [set(sigs[deleted].tolist()) for sigs, _, deleted in second]
            units = 2 * len(whole[0] & whole[1]) + len(whole[0] & less[1]) + len(less[0] & whole[1])
            total = len(one) + len(other)
            need = 2 * jaccard_join.double_segments(band, percent) - jaccard_join.most_different(total, percent)
            assert need > 0 and units >= need


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    links += [(300 + i, 300 + (i + 7) % 50) for i in range(50)] + [(5, 5), (7, 6), (6, 7), (None, 3)]
    union = Union()
    for x, y in links:
        if x is not None and x != y:
            union.join(x, y)
    frame = spark.createDataFrame(links, "x long, y long")
    found = {row["node"]: row["component"] for row in connected_components(frame, "x", "y").collect()}
    assert found == {x: union.find(x) for x in union.parent}
    assert connected_components(frame.limit(0), "x", "y").count() == 0


def test_shingle_sizes_match_the_definition():
    for text in ("a b c d e f", "a a a a a a a", "A b\tc\x0bd e f g", "", "x"):
        assert len(jaccard_join.shingle_set(text)) == len(shingles(text))


def test_sketches_differ_in_no_more_places_than_sets(make_docs):
    draw = random.Random(12)
    base = [f"w{draw.randint(0, 400)}" for _ in range(300)]
    rows = []
    for at in range(40):
        words = list(base)
        for _ in range(at):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 10**6)}"
        rows.append((at, " ".join(words)))
    rows.append((99, "one two"))
    found = {r["doc_id"]: [r[f"s{k}"] for k in range(jaccard_join.SKETCH_WORDS)] for r in jaccard_join.parity_sketches(make_docs(rows)).collect()}
    sets = {doc_id: shingles(text) for doc_id, text in rows}
    far = 0
    for x, one in sets.items():
        for y, other in sets.items():
            apart = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(found[x], found[y], strict=True))
            assert apart <= len(one ^ other)
            far += apart >= 0.6 * len(one ^ other) > 0
    assert far > 200


def test_pairs_across_parts_are_those_of_all_lists(spark, make_docs, monkeypatch):
    """Sets that share runs of lists: a pair is left out only where an earlier list has made it."""
    rng = random.Random(5)
    words = [f"w{n}" for n in range(60)]
    rows = [(doc, " ".join(words[:50] + rng.sample(words, 10))) for doc in range(12)]
    sizes = {doc: len(jaccard_join.shingle_set(text)) for doc, text in rows}
    lists = [
        (segment * 10 + rng.randrange(3) * (1 + deleted), doc, 1, segment, deleted, sizes[doc], doc % 5)
        for doc in range(12) for segment in range(8) for deleted in (False, True) if rng.random() < 0.7
    ]
    frame = spark.createDataFrame(
        lists, "sig long, doc_id long, band int, segment int, deleted boolean, n int, part long"
    )
    monkeypatch.setattr(jaccard_join, "EARLIER", 2)
    found = jaccard_join.pairs_across(frame, make_docs(rows), 1).select("a", "b").collect()
    wanted = {
        (x[1], y[1]) for x in lists for y in lists
        if x[0] == y[0] and x[1] < y[1] and x[6] != y[6] and not (x[4] and y[4])
    }
    assert len(found) == len(wanted) and {tuple(row) for row in found} == wanted


def test_sets_of_unlike_pairs_are_not_carried(make_docs):
    rng = random.Random(17)
    base = [rng.choice(VOCABULARY) for _ in range(400)]
    near = [*base[:390], *(rng.choice(VOCABULARY) for _ in range(10))]
    half = [*base[:200], *(rng.choice(VOCABULARY) for _ in range(200))]
    texts = make_docs([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(half)), (4, "one"), (4, " ".join(base))])
    pairs = texts.sparkSession.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (1, 4)], "a long, b long")
    likely = jaccard_join.likely_pairs(pairs, jaccard_join.shingle_sets(texts), 75)
    # The second text of 4 is like that of 1.
    assert sorted(map(tuple, likely.collect())) == [(1, 2), (1, 4)]
    assert sorted(map(tuple, jaccard_join.verified(pairs, texts, 75).distinct().collect())) == [(1, 2), (1, 4)]


def test_index_rows_leave_in_small_batches(make_docs):
    texts = make_docs([(at, f"w{at} a b c d {at}") for at in range(600)]).selectExpr("doc_id", "doc_id AS text_key", "text")
    assert jaccard_join.subset_index(texts, 75).filter("code % 4 = 2").select("sig").distinct().count() == 600
    sigs = jaccard_join.subset_index(texts, 75).filter("code % 4 <> 2").selectExpr("min(sig) AS low", "max(sig) AS high").first()
    assert 0 <= sigs["low"] and sigs["high"] < 1 << 48


def test_a_pair_that_shares_many_lists_is_made_once(spark):
    """Two sets share the first whole subset and, from 15 others on, subsets with one element less."""
    rows = []
    for doc_id in (1, 2):
        rows += [(segment if segment == 0 else 1000 * doc_id + segment, doc_id, 0, segment, False) for segment in range(20)]
        rows += [(5000 + segment, doc_id, 0, segment, doc_id == 1) for segment in range(15, 20)]
    lists = spark.createDataFrame(rows, "sig long, doc_id long, band int, segment int, deleted boolean")
    lists = lists.selectExpr("*", "20 AS n", "20 AS m", "9 AS differ", "doc_id AS part")
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    assert jaccard_join.list_pairs(lists, texts, 75).count() == 1
    assert [tuple(row) for row in jaccard_join.pairs_across(lists, texts, 75).collect()] == [(1, 2)]
