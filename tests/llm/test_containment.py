from __future__ import annotations

import random

from seekloom.llm.containment import contained_items
from tests.llm.brute import shingles


def text_of(rng, count):
    return " ".join(f"v{rng.randrange(3000)}" for _ in range(count))


def test_equals_brute_force(spark, make_docs):
    rng = random.Random(11)
    items = [(i, text_of(rng, n)) for i, n in enumerate([5, 6, 9, 14, 15, 20, 35, 59, 200])]
    items += [(20, "three short words"), (21, ""), (22, None), (None, "no id at all here"), (23, items[3][1])]
    docs = [(i, text_of(rng, int(3 * 1.6 ** rng.uniform(0, 15)))) for i in range(60)]
    for at in range(60, 110):
        item = rng.choice([text for _, text in items[:9]]).split()
        for _ in range(rng.randrange(3)):
            item[rng.randrange(len(item))] = "edited"
        around = text_of(rng, rng.randrange(4000)).split()
        place = rng.randrange(len(around) + 1)
        docs.append((at, " ".join([*around[:place], *item, *around[place:]])))
    docs += [(200, "Three SHORT\twords"), (201, "three short words and more"), (202, None), (203, ""), (None, items[4][1])]
    docs += [docs[60], docs[60]]
    frame = spark.createDataFrame([(i, t, "clash", 0) for i, t in items], "item_id long, text string, lang string, n_item int")
    found = sorted(tuple(row) for row in contained_items(make_docs(docs), frame).collect())
    wanted = set()
    for doc_id, text in docs:
        for item_id, item in items:
            own = shingles(item)
            both = len(own & shingles(text))
            if doc_id is not None and item_id is not None and own and 100 * both >= 75 * len(own):
                wanted.add((doc_id, item_id, both, len(own)))
    assert found == sorted(wanted)
    assert contained_items(make_docs([]), frame).count() == 0
    assert contained_items(make_docs(docs), frame.limit(0)).count() == 0
