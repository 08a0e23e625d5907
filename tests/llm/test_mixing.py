from __future__ import annotations

import math

from seekloom.llm.mixing import mixed_rows, systematic_mix
from tests.llm.conftest import rows_by_id


def test_targets_are_capped_and_reshared(make_docs):
    rows = [(1, "a b c d e f", "big"), (2, "a b", None), (3, "x y z q", "c"), (4, None, "c")]
    found = rows_by_id(systematic_mix(make_docs(rows)))
    # All 12 words; weights big 1, c 2, null 3; the null source stops at 3 * 2.
    assert found[2]["target"] == 6.0
    assert math.isclose(found[1]["target"], 2.0)
    assert math.isclose(found[3]["target"], 4.0)
    assert found[4]["size"] == 0 and found[4]["taken"] == 0


def test_taken_is_near_the_target_and_repeats(make_docs):
    rows = [(i, "w " * (1 + i * 7 % 90), f"s{i % 3}") for i in range(900)]
    first = systematic_mix(make_docs(rows)).collect()
    again = systematic_mix(make_docs(list(reversed(rows)))).collect()
    assert sorted(first) == sorted(again)
    for source in {row["source"] for row in first}:
        own = [row for row in first if row["source"] == source]
        assert abs(sum(row["taken"] for row in own) - own[0]["target"]) <= 0.02 * own[0]["target"]
        assert all(row["copies"] <= 3 for row in own)


def test_empty_tables_repeated_rows_and_wordless_sources(make_docs):
    assert systematic_mix(make_docs([])).count() == 0
    blank = systematic_mix(make_docs([(1, " \n", "a"), (1, " \n", "a"), (None, None, None)]))
    assert [row["taken"] for row in blank.collect()] == [0, 0, 0]
    rows = [(1, "a b", "a"), (2, "c d", "b"), (2, "c d", "b"), (2, "c d e", "b"), (None, "f g", None), (None, "f g", None)]
    docs = make_docs(rows)
    copies = {}
    for row in systematic_mix(docs).collect():
        copies[row["doc_id"], row["size"]] = copies.get((row["doc_id"], row["size"]), 0) + row["copies"]
    mixed = mixed_rows(docs)
    assert mixed.columns == docs.columns
    found = {}
    for row in mixed.collect():
        key = (row["doc_id"], len(row["text"].split()))
        found[key] = found.get(key, 0) + 1
    assert found == {key: n for key, n in copies.items() if n}
