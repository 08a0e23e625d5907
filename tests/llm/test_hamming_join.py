from __future__ import annotations

import numpy as np
import pytest

from seekloom.llm import hamming_join
from tests.llm.brute import Union

SCHEMA = "vec_id long, embedding array<float>, label int, class_id int, copies string, first string"


def frame_of(spark, rows):
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x", "y") for i, v in rows]
    return spark.createDataFrame(full, SCHEMA)


def brute(rows, cosine=0.95):
    """Links by all pairs; rows are vectors even if they share an id."""
    good = []
    for at, (vec_id, vector) in enumerate(rows):
        usable = vec_id is not None and vector is not None and len(vector) and all(x is not None and np.isfinite(x) for x in vector)
        if usable and any(x != 0 for x in vector):
            good.append((at, np.float32(vector).astype(np.float64)))
    union, links = Union(), {at: 0 for at in range(len(rows))}
    for k, (x, one) in enumerate(good):
        for y, other in good[:k]:
            if len(one) == len(other) and one @ other / np.linalg.norm(one) / np.linalg.norm(other) >= cosine:
                links[x] += 1
                links[y] += 1
                union.join(x, y)
    least = {}
    for at, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            root = union.find(at)
            least[root] = min(least.get(root, vec_id), vec_id)
    result = []
    for at, (vec_id, _) in enumerate(rows):
        first = None if vec_id is None else least[union.find(at)]
        result.append((vec_id, links[at], first, first == vec_id))
    return sorted(result, key=str)


def near(draw, base, cosine):
    move = draw.standard_normal(len(base))
    move -= move @ base / (base @ base) * base
    move *= np.linalg.norm(base) / np.linalg.norm(move)
    return cosine * base + np.sqrt(1 - cosine**2) * move


def clusters(seed, dims=32, families=40, loose=300):
    draw = np.random.default_rng(seed)
    rows = [draw.standard_normal(dims) for _ in range(loose)]
    for _ in range(families):
        base = draw.standard_normal(dims)
        rows += [near(draw, base, draw.uniform(0.96, 0.999)) for _ in range(draw.integers(2, 12))]
    draw.shuffle(rows)
    return [(at, row) for at, row in enumerate(rows)]


def collected(found):
    return sorted((tuple(row) for row in found.collect()), key=str)


def test_clusters_against_brute_force(spark):
    rows = clusters(1)
    want = brute(rows)
    found = collected(hamming_join.near_duplicate_vectors(frame_of(spark, rows)))
    assert [row[0] for row in found] == [row[0] for row in want]
    links = sum(row[1] for row in want)
    assert sum(row[1] for row in found) >= 0.97 * links > 1000
    assert all(got[1] <= full[1] and got[2] >= full[2] for got, full in zip(found, want, strict=True))


def test_edge_cases_have_defined_results(spark):
    one, other = [1.0, 2.0, 0.5], [1.0, 2.1, 0.5]
    rows = [
        (5, one), (3, one), (9, other), (7, [-1.0, 2.0, 0.5]), (None, one), (None, None), (11, None), (12, []),
        (13, [0.0, 0.0, 0.0]), (14, [1.0, None, 0.5]), (15, [1.0, float("nan"), 0.5]), (16, [float("inf"), 2.0, 0.5]),
        (17, [1.0, 2.0]), (18, [2.0, 4.0, 1.0]), (5, [0.0, 0.0, 1.0]), (20, [1e30, 2e30, 5e29]), (21, [1.0, 2.0, 0.5, 0.0]),
    ]
    found = collected(hamming_join.near_duplicate_vectors(frame_of(spark, rows)))
    assert found == brute(rows)
    assert (11, 0, 11, True) in found and (18, 4, 3, False) in found


def test_empty_and_single_rows(spark):
    assert hamming_join.near_duplicate_vectors(frame_of(spark, [])).count() == 0
    assert collected(hamming_join.near_duplicate_vectors(frame_of(spark, [(1, None)]))) == [(1, 0, 1, True)]
    assert collected(hamming_join.near_duplicate_vectors(frame_of(spark, [(1, [3.0])]))) == [(1, 0, 1, True)]
    many = [(at, [1.0, 2.0]) for at in range(500)]
    found = collected(hamming_join.near_duplicate_vectors(frame_of(spark, many)))
    assert {row[1:3] for row in found} == {(499, 0)} and sum(row[3] for row in found) == 1


def test_crowded_keys_are_compared_in_blocks(spark, monkeypatch):
    """One group of near copies that is larger than a block, each pair counted once."""
    draw = np.random.default_rng(4)
    base = draw.standard_normal(16)
    rows = [(at, near(draw, base, 0.99)) for at in range(260)] + clusters(2, 16, 5, 60)
    rows = [(at, row) for at, (_, row) in enumerate(rows)]
    monkeypatch.setattr(hamming_join, "BLOCK", 50)
    monkeypatch.setattr(hamming_join, "_ROWS", 64)
    found = collected(hamming_join.near_duplicate_vectors(frame_of(spark, rows)))
    want = brute(rows)
    assert sum(row[1] for row in found) >= 0.98 * sum(row[1] for row in want)
    assert all(got[1] <= full[1] for got, full in zip(found, want, strict=True))
    monkeypatch.setattr(hamming_join, "BLOCK", 100_000)
    assert collected(hamming_join.near_duplicate_vectors(frame_of(spark, rows))) == found


@pytest.mark.parametrize("dims", [24, 64, 100])
def test_recall_at_the_threshold(dims):
    """Codes of pairs just at the threshold, on vectors with a few strong directions."""
    draw = np.random.default_rng(dims)
    scale = 1 / np.sqrt(1 + np.arange(dims))
    sample = hamming_join.unit_rows(draw.standard_normal((4000, dims)) * scale)
    index = hamming_join.learn_index(sample[:2000], 1_000_000, 0.95)
    one = sample[2000:]
    other = np.array([near(draw, row, 0.95) for row in one])
    (sketch, keys), (sketch_2, keys_2) = index.encode(one), index.encode(hamming_join.unit_rows(other))
    met = (keys == keys_2).any(axis=1) & (hamming_join._distance(sketch, sketch_2) <= index.radius)
    assert met.mean() >= 0.97 and index.key_bits >= 8
    balance = np.array([(row >> np.arange(index.key_bits)) & 1 for row in keys[:, 0]]).mean(axis=0)
    assert abs(balance - 0.5).max() < 0.1
