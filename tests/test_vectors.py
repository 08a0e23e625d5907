"""Vector search against brute force, in all its physical forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekloom.config import Budget
from seekloom.operators import cell_tree, vectors
from seekloom.operators.embed import embed_hashed, embed_texts, mean_pool
from seekloom.plans.sizing import keys_fit

DIM, N, NQ, K = 8, 300, 12, 5
NOTHING_FITS = Budget(0, 0)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    corpus = rng.normal(size=(N, DIM)).astype(np.float32)
    corpus[50:60] = corpus[40:50]  # ties
    asked = rng.normal(size=(NQ, DIM)).astype(np.float32)
    ids = [f"v{i}" for i in range(N)]
    corpus_frame = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in zip(ids, corpus, strict=True)],
        "chunk_id string, embedding array<float>",
    ).repartition(5)
    query_frame = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(asked)],
        "query_id long, query_vector array<float>",
    )
    scores = asked.astype(np.float64) @ corpus.astype(np.float64).T
    expected = {
        q: sorted(ids, key=lambda c, q=q: (-round(scores[q, int(c[1:])], 8), c))[:K]
        for q in range(NQ)
    }
    return query_frame, corpus_frame, expected, scores


def ranked(frame):
    found = {}
    for row in sorted(frame.collect(), key=lambda r: r["rank"]):
        found.setdefault(row.query_id, []).append(row.chunk_id)
    return found


def test_exact_matches_brute_force(data):
    queries, corpus, expected, scores = data
    found = vectors.vector_topk(queries, corpus, K)
    assert ranked(found) == expected
    for row in found.collect():
        assert row.search_score == pytest.approx(scores[row.query_id, int(row.chunk_id[1:])])


def test_blocks_match_brute_force(data, monkeypatch):
    queries, corpus, expected, _ = data
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    found = vectors.vector_topk(queries, corpus, K, budget=NOTHING_FITS)
    assert ranked(found) == expected
    assert vectors.vector_topk(queries.limit(0), corpus, K, budget=NOTHING_FITS).count() == 0


def test_the_corpus_stays_in_place_for_large_query_tables(data, monkeypatch, plan_text):
    """No plan of the search exchanges or repeats the corpus before its local top-k."""
    queries, corpus, _, _ = data
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    scanned, scan = [], vectors._scan_with_broadcast

    def watched(rows, table, *rest):
        scanned.append(rows.num_rows)
        local = scan(rows, table, *rest)
        plan = plan_text(local)
        assert "MapInArrow" in plan and "Generate" not in plan and "CoGroup" not in plan
        assert "Exchange" not in plan.split("MapInArrow")[0]
        return local

    monkeypatch.setattr(vectors, "_scan_with_broadcast", watched)
    stored = vectors.written(corpus, "corpus")
    vectors.vector_topk(queries, stored, K, budget=NOTHING_FITS).collect()
    assert sum(scanned) == NQ and len(scanned) == 3
    model = vectors.fit_cells(corpus, n_cells=6)
    index = vectors.written(vectors.assign_cells(corpus, model), "cells")
    scanned.clear()
    vectors.vector_topk_approx(queries, index, model, K, n_probe=2, budget=NOTHING_FITS).collect()
    assert len(scanned) == 5 and max(scanned) <= 9


def test_small_pool_and_slices_change_nothing(data, monkeypatch):
    queries, corpus, expected, _ = data
    monkeypatch.setattr(vectors, "POOL_ROWS", 10)
    monkeypatch.setattr(vectors, "QUERY_SLICE", 3)
    assert ranked(vectors.vector_topk(queries, corpus, K)) == expected


def test_fewer_vectors_than_k_null_vectors_and_no_queries(spark, data):
    queries, corpus, _, _ = data
    few = corpus.filter("chunk_id in ('v1', 'v2')").unionByName(
        spark.createDataFrame([("none", None)], corpus.schema)
    )
    assert all(len(ids) == 2 for ids in ranked(vectors.vector_topk(queries, few, K)).values())
    assert vectors.vector_topk(queries.limit(0), corpus, K).count() == 0


def test_different_dimensions_are_an_error(spark, data):
    queries, _, _, _ = data
    wrong = spark.createDataFrame([("x", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    with pytest.raises(Exception, match="dimension"):
        vectors.vector_topk(queries, wrong, K).collect()


def test_approximate_index_recall_and_full_probe(data, monkeypatch):
    queries, corpus, expected, _ = data
    model = vectors.fit_cells(corpus, n_cells=6)
    index = vectors.assign_cells(corpus, model)
    everything = vectors.vector_topk_approx(queries, index, model, K, n_probe=6)
    assert ranked(everything) == expected
    some = ranked(vectors.vector_topk_approx(queries, index, model, K, n_probe=4))
    recall = np.mean([len(set(some.get(q, [])) & set(expected[q])) / K for q in expected])
    assert recall >= 0.7
    for rows in (4, 4096):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", rows)
        blocks = vectors.vector_topk_approx(queries, index, model, K, n_probe=4, budget=NOTHING_FITS)
        assert ranked(blocks) == some


def test_two_levels_of_cells(data, spark, tmp_path):
    queries, corpus, expected, _ = data
    tree = cell_tree.fit_cell_tree(corpus, n_coarse=5, cell_rows=20)
    fine = {r.cell: (r.coarse, np.array(r.center)) for r in tree.fine.collect()}
    assert 10 <= len(fine) <= 20 and sorted(fine) == list(range(len(fine)))
    path = str(tmp_path / "tree-cells")
    cell_tree.assign_tree_cells(corpus, tree).write.partitionBy("cell").parquet(path)
    index = spark.read.schema("chunk_id string, embedding array<float>, cell int").parquet(path)
    rows = index.collect()
    assert len(rows) == N
    coarse = np.stack(tree.coarse.clusterCenters())
    for row in rows:
        own = int(((coarse - np.array(row.embedding)) ** 2).sum(axis=1).argmin())
        near = {c: ((center - np.array(row.embedding)) ** 2).sum() for c, (top, center) in fine.items() if top == own}
        assert near[row.cell] <= min(near.values()) + 1e-9
    largest = max(sum(r.cell == cell for r in rows) for cell in fine)
    assert largest <= 80
    everything = cell_tree.vector_topk_tree(queries, index, tree, K, n_probe=len(fine), n_coarse=5)
    assert ranked(everything) == expected
    some = ranked(cell_tree.vector_topk_tree(queries, index, tree, K, n_probe=8, n_coarse=3))
    assert np.mean([len(set(some.get(q, [])) & set(expected[q])) / K for q in expected]) >= 0.7
    blocks = cell_tree.vector_topk_tree(queries, index, tree, K, n_probe=8, n_coarse=3, budget=NOTHING_FITS)
    assert ranked(blocks) == some
    assert cell_tree.vector_topk_tree(queries.limit(0), index, tree, K).count() == 0


def test_a_large_coarse_cell_is_dealt_over_lanes(data, monkeypatch):
    _, corpus, _, _ = data
    tree = cell_tree.fit_cell_tree(corpus, n_coarse=2, cell_rows=30)
    want = {r.chunk_id: r.cell for r in cell_tree.assign_tree_cells(corpus, tree).collect()}
    monkeypatch.setattr(cell_tree, "target_rows", lambda rows: (20, 4))
    assert {r.chunk_id: r.cell for r in cell_tree.assign_tree_cells(corpus, tree).collect()} == want


def test_probed_cells_prune_partitions(spark, data, tmp_path, plan_text):
    queries, corpus, _, _ = data
    model = vectors.fit_cells(corpus, n_cells=6)
    vectors.assign_cells(corpus, model).write.partitionBy("cell").parquet(str(tmp_path / "cells"))
    stored = spark.read.schema("chunk_id string, embedding array<float>, cell int").parquet(
        str(tmp_path / "cells")
    )
    plan = plan_text(vectors.vector_topk_approx(queries.limit(1), stored, model, K, n_probe=1))
    assert "PartitionFilters: [cell" in plan or "cell#" in plan.split("PartitionFilters:")[1][:80]


def test_refresh_replaces_changed_vectors_only(spark, data):
    _, corpus, _, _ = data
    model = vectors.fit_cells(corpus, n_cells=6)
    index = vectors.assign_cells(corpus, model)
    changed = corpus.filter("chunk_id = 'v3'").withColumn("embedding", F.reverse("embedding"))
    changed = changed.unionByName(corpus.filter("chunk_id = 'v4'").withColumn("chunk_id", F.lit("new")))
    after = vectors.refresh_cells(index, changed, model, keys_fit(changed, "chunk_id"))
    assert after.count() == N + 1
    direct = vectors.assign_cells(changed, model)
    assert after.join(direct, ["chunk_id", "cell"], "left_semi").count() == 2


def test_vector_search_adds_text_and_checks_inputs(spark, data, make_chunks):
    queries, corpus, expected, _ = data
    chunks = make_chunks({"v1": "one"})
    rows = vectors.vector_search(queries, corpus, chunks, K).collect()
    assert len(rows) == NQ * K
    assert {r.text for r in rows if r.chunk_id == "v1"} <= {"one"}
    with pytest.raises(ValueError):
        vectors.vector_search(queries.drop("query_vector"), corpus, chunks, K)
    texts = spark.createDataFrame([(1, "one two")], "query_id long, query_text string")
    found = vectors.vector_search(texts, corpus, chunks, K, embed=lambda q: embed_hashed(q, DIM))
    assert found.count() == K


def test_mean_pool():
    values = np.array([[[1.0, 0.0], [0.0, 2.0], [9.0, 9.0]]])
    pooled = mean_pool(values, np.array([[1, 1, 0]]))
    assert pooled[0] == pytest.approx(np.array([0.5, 1.0]) / np.sqrt(1.25))


def test_embed_texts_batches_and_nulls(spark):
    seen = "query_id long, query_text string"
    frame = spark.createDataFrame([(i, "x" * i if i else None) for i in range(5)], seen).coalesce(1)

    def factory():
        def model(texts):
            assert len(texts) <= 2
            values = np.array([[[len(t), 1.0]] for t in texts])
            return values, np.ones((len(texts), 1))

        return model

    rows = embed_texts(frame, factory, batch_size=2).collect()
    for row in rows:
        n = row.query_id
        assert row.query_vector == pytest.approx(np.array([n, 1.0]) / np.hypot(n, 1.0), rel=1e-6)


def test_hashed_embedding_is_normalised(spark):
    frame = spark.createDataFrame([(1, "a b c a"), (2, "")], "query_id long, query_text string")
    rows = {r.query_id: r.query_vector for r in embed_hashed(frame, 32).collect()}
    assert np.linalg.norm(rows[1]) == pytest.approx(1.0, rel=1e-6)
    assert len(rows[2]) == 32 and not any(rows[2])


def test_queries_whose_hits_fill_the_pool_go_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    schema = "chunk_id string, embedding array<float>"
    corpus = spark.createDataFrame([(f"v{i}", rng.normal(size=4).tolist()) for i in range(30)], schema)
    asked = corpus.selectExpr("chunk_id AS query_id", "embedding AS query_vector")
    whole = sorted(map(tuple, vectors.vector_topk(asked, corpus, 3).collect()))
    monkeypatch.setattr(vectors, "POOL_ROWS", 60)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    sent, scan = [], vectors._scan_with_broadcast
    monkeypatch.setattr(vectors, "_scan_with_broadcast", lambda rows, *rest: sent.append(rows.num_rows) or scan(rows, *rest))
    assert sorted(map(tuple, vectors.vector_topk(asked, corpus, 3).collect())) == whole
    assert len(sent) == 3 and sum(sent) == 30


def test_ranking_cells_is_bounded_by_values(monkeypatch):
    import pyarrow as pa

    from seekloom.operators import cell_tree

    rng = np.random.default_rng(6)
    points, centers = rng.normal(size=(40, 4)), rng.normal(size=(20, 4))
    part = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(40)], "vector": points.tolist()})
    monkeypatch.setattr(cell_tree, "RANKED_VALUES", 100)
    found = list(cell_tree._ranked(part, points, centers, np.arange(20, dtype=np.int32), 15, False))
    assert max(batch.num_rows for batch in found) <= 100 and sum(batch.num_rows for batch in found) == 600
    assert all(batch.column("vector").null_count == batch.num_rows for batch in found)
    nearest = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).argsort(axis=1)[:, :15]
    assert np.concatenate([batch.column("cell").to_numpy() for batch in found]).tolist() == nearest.ravel().tolist()
