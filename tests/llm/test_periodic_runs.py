from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seekloom.llm import periodic_runs
from seekloom.llm.queries import planted_words
from tests.llm.brute import WORD
from tests.llm.conftest import rows_by_id


def brute_runs(words):
    """Every lag in turn; of one stretch the smallest period counts."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if length >= max(6, 4 * q):
                found.setdefault((at, length), q)
            at = end
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda run: (run[0], run[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    text = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, *(hashlib.sha256(t.encode()).hexdigest() for t in (text, kept)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_runs_of_few_words(words):
    assert periodic_runs.find_runs(words) == brute_runs(words)


def test_runs_of_random_mixtures():
    draw = random.Random(5)
    for _ in range(400):
        words = []
        while len(words) < draw.choice([30, 200, 600]):
            block = [draw.choice("abcdefgh"[: draw.randint(1, 8)]) for _ in range(draw.randint(1, 40))]
            words += block * draw.choice([1, 1, 3, 4, 5, 9]) + block[: draw.randint(0, len(block))]
            words += draw.choice([[], [f"u{draw.random()}"], [draw.choice("abc")]])
        assert periodic_runs.find_runs(words) == brute_runs(words)


def test_splitting_runs_to_stability():
    words = list("xyxyxyxy") + ["u"] + list("xyxy") + ["v"] + list("zzz")
    assert periodic_runs.surviving_segments(words) == [(0, 8)]
    draw = random.Random(7)
    for _ in range(300):
        words = [draw.choice("abcdefghijkl") for _ in range(draw.randint(0, 80))]
        kept = periodic_runs.surviving_segments(words)
        inside = {at for low, high in kept for at in range(low, high)}
        plain, todo = [], [(0, len(words))]
        while todo:
            low, high = todo.pop()
            part = words[low:high]
            cuts = [at for at in range(low, high) if part.count(words[at]) < 4]
            if not cuts:
                plain += [(low, high)] if high - low >= 6 else []
                continue
            todo += [(a + 1, b) for a, b in zip([low - 1, *cuts], [*cuts, high], strict=True)]
        assert kept == sorted(plain) and all(high - low >= 6 for low, high in kept)
        assert len(inside) == sum(high - low for low, high in kept)


def test_deep_recursion_and_long_texts_stay_cheap():
    chain = ["u"]
    for at in range(20_000):
        chain += [f"a{at}", f"a{at + 1}", f"a{at}", f"a{at}"]
    assert periodic_runs.find_runs(chain) == []
    block = [f"w{at % 977}" for at in range(50_000)]
    found = periodic_runs.find_runs(block * 5)
    assert found[:2] == [(0, 50_000, 977), (0, 250_000, 50_000)]
    assert periodic_runs.find_runs(["w"] * 200_000) == [(0, 200_000, 1)]
    unlike = [f"w{at * at % 50_021}" for at in range(50_000)]
    assert periodic_runs.find_runs(unlike * 4)[-1] == (0, 200_000, 50_000)


def test_table_against_brute_force(make_docs):
    draw = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a a a a a a a"), (4, "x y " * 9), (4, "x y " * 9)]
    rows += [(5, "b b b b b"), (6, "b b b b b b"), (7, "é\x0bé\x0cé\ré é\té　"), (8, "A a A a A a A a")]
    for at in range(100, 400):
        rows.append((at, " ".join(draw.choice("the a of to in on".split()) for _ in range(draw.randint(1, 90)))))
    found = periodic_runs.run_digests(periodic_runs.collapse_runs(make_docs(rows), planted_words))
    got = sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in found.collect())
    assert got == sorted((str(doc_id), *brute_row(doc_id, text)) for doc_id, text in rows)
    assert sum(r[1] > 0 for r in got) > 15


def test_collapsed_texts_and_empty_table(make_docs):
    found = periodic_runs.collapse_runs(make_docs([(1, "say " + "so it goes " * 5 + "on"), (2, None)]))
    found = rows_by_id(found)
    assert found[1]["collapsed"] == "say so it goes on" and found[1]["runs"][0] == (1, 15, 3)
    assert (found[2]["collapsed"], found[2]["runs"], found[2]["n_words"]) == ("", [], 0)
    empty = periodic_runs.run_digests(periodic_runs.collapse_runs(make_docs([])))
    assert empty.count() == 0
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(make_docs([]), repeats=3)
