"""Upserts, incremental index, ingest runs and the stream."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekloom.config import KeywordConfig, LakeConfig
from seekloom.operators.audit import coverage, coverage_sql, match_audit, source_files
from seekloom.operators.bm25_index import build_index
from seekloom.operators.bm25_update import update_index
from seekloom.operators.lexicon import Lexicon
from seekloom.operators.terms import select_terms
from seekloom.operators.upsert import latest_per_key, upsert
from seekloom.plans.ingest import ingest, rebuild_keyword_index
from seekloom.sources.snapshots import compact, current
from seekloom.streaming.ingest_stream import start_ingest_stream, start_vector_stream

WORDS = ["flood", "river", "fema", "alpha", "beta", "42", "tx", "gamma"]
EMB = "chunk_id string, embedding array<float>"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def index_rows(index):
    meta = index.meta.first()
    return (
        rows(index.postings.select("term", "chunk_id", "tf", "doc_len")),
        rows(index.doc_stats.select("chunk_id", "doc_len")),
        rows(index.df.select("term", "df")),
        (meta["N"], None if meta["avgdl"] is None else round(meta["avgdl"], 9)),
    )


def texts(seed, ids):
    rng = random.Random(seed)
    return {f"c{i}": " ".join(rng.choices(WORDS, k=rng.randint(0, 6))) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("fits", [True, False])
def test_update_equals_rebuild_and_repeats_as_no_op(make_chunks, seed, fits):
    base, batch = texts(seed, range(12)), texts(seed + 50, range(8, 16))
    index = build_index(make_chunks(base))
    after = update_index(index, make_chunks(batch), fits)
    expected = index_rows(build_index(make_chunks({**base, **batch})))
    assert index_rows(after) == expected
    assert index_rows(update_index(after, make_chunks(batch), fits)) == expected


def test_reingest_without_tokens_drops_the_chunk(make_chunks):
    index = build_index(make_chunks({"c1": "flood map", "c2": "river"}))
    after = index_rows(update_index(index, make_chunks({"c1": "42"}), True))
    assert after[1] == [("c2", 1)] and after[2] == [("river", 1)] and after[3] == (1, 1.0)


def test_latest_per_key(spark):
    frame = spark.createDataFrame(
        [("a", "f1", "old", 1), ("a", "f2", "new", 2), ("b", "f", "z", 1), ("b", "f", "y", 1)],
        "chunk_id string, source_file string, text string, at int",
    )
    assert rows(latest_per_key(frame, prefer=["at"]).select("chunk_id", "text")) == [
        ("a", "new"), ("b", "z"),
    ]
    assert rows(latest_per_key(frame, prefer=["text"]).select("chunk_id", "text")) == [
        ("a", "old"), ("b", "z"),
    ]


def test_upsert_replaces_and_adds(make_chunks):
    before, batch = make_chunks({"a": "1", "b": "2"}), make_chunks({"b": "3", "c": "4"})
    for fits in (True, False):
        after = upsert(before, batch, fits)
        assert rows(after.select("chunk_id", "text")) == [("a", "1"), ("b", "3"), ("c", "4")]


def vectors(spark, ids, value=1.0):
    return spark.createDataFrame([(i, [float(value), 0.0]) for i in ids], EMB)


def test_ingest_runs(spark, make_chunks, tmp_path):
    lake = LakeConfig(str(tmp_path / "lake"), chunk_buckets=3, term_buckets=2)
    first, second = texts(7, range(10)), texts(8, range(6, 14))
    report = ingest(
        spark, lake, make_chunks(first), vectors(spark, [f"c{i}" for i in range(5)] + ["x"], 2.0)
    ).first()
    assert (report.chunks_text, report.embeddings, report.wide) == (10, 6, 5)
    assert report.keyword_mode == "full" and report.version == 1

    # New vectors for old chunks, new texts, and a duplicate id within the batch.
    batch = make_chunks(second).unionByName(make_chunks({"c6": ""}))
    report = ingest(spark, lake, batch, vectors(spark, ["c6", "c0"], 3.0)).first()
    assert report.keyword_mode == "incremental"
    assert (report.chunks_text, report.affected_chunks) == (8, 8)
    merged = {**first, **second}
    snapshot = current(spark, lake)
    assert rows(snapshot.rows(spark, "chunks").select("chunk_id", "text")) == sorted(merged.items())
    assert index_rows(snapshot.index(spark)) == index_rows(build_index(make_chunks(merged)))
    wide = {r.chunk_id: (r.text, r.embedding[0]) for r in snapshot.rows(spark, "wide").collect()}
    assert set(wide) == {"c0", "c1", "c2", "c3", "c4", "c6"}
    assert wide["c6"] == (merged["c6"], 1.0)  # vectors have length one

    # The same batch again changes no rows.
    before = index_rows(snapshot.index(spark))
    again = ingest(spark, lake, batch, vectors(spark, ["c6", "c0"], 3.0)).first()
    assert again.df_terms_changed == 0
    assert index_rows(current(spark, lake).index(spark)) == before

    # Older partitions that hold none of the ids stay as they are.
    ingest(spark, lake, make_chunks({"only": "alpha beta"}))
    latest = current(spark, lake)
    assert any(gen < latest.version for gen, _ in latest.partitions("chunks"))

    counts = rebuild_keyword_index(spark, lake).first()
    merged["only"] = "alpha beta"
    rebuilt = index_rows(current(spark, lake).index(spark))
    assert rebuilt == index_rows(build_index(make_chunks(merged)))
    assert counts.postings == len(rebuilt[0])


def test_unpublished_writes_are_not_seen(spark, make_chunks, tmp_path, monkeypatch):
    from seekloom.plans import ingest as module

    lake = LakeConfig(str(tmp_path / "lake"), chunk_buckets=2, term_buckets=2)
    ingest(spark, lake, make_chunks({"a": "flood"}))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(module, "publish", fail)
        with pytest.raises(RuntimeError):
            ingest(spark, lake, make_chunks({"a": "river", "b": "fema"}))
    assert rows(current(spark, lake).rows(spark, "chunks").select("chunk_id", "text")) == [("a", "flood")]
    ingest(spark, lake, make_chunks({"a": "river", "b": "fema"}))
    assert rows(current(spark, lake).rows(spark, "df")) == [("fema", 1), ("river", 1)]


def test_wide_scope_indexes_chunks_with_vectors(spark, make_chunks, tmp_path):
    lake = LakeConfig(str(tmp_path / "lake"), 2, 2, index_scope="wide")
    ingest(spark, lake, make_chunks({"a": "flood", "b": "river"}), vectors(spark, ["a"]))
    assert rows(current(spark, lake).rows(spark, "df")) == [("flood", 1)]
    # The vector of an older chunk arrives later, which brings the chunk into scope.
    ingest(spark, lake, make_chunks({"c": "fema"}), vectors(spark, ["b"]))
    assert rows(current(spark, lake).rows(spark, "df")) == [("flood", 1), ("river", 1)]


def test_cells_are_refreshed_with_the_ingest(spark, make_chunks, tmp_path):
    from seekloom.operators.vectors import fit_cells

    lake = LakeConfig(str(tmp_path / "lake"), 2, 2)
    ids = [f"c{i}" for i in range(6)]
    base = spark.createDataFrame([(c, [float(i % 2), float((i + 1) % 2)]) for i, c in enumerate(ids)], EMB)
    ingest(spark, lake, make_chunks({c: "flood" for c in ids}), base)
    model = fit_cells(base, 2)
    report = ingest(
        spark, lake, make_chunks({"c1": "river"}), vectors(spark, ["c0"]), cell_model=model
    ).first()
    assert report.vector_index == "refreshed"
    cells = current(spark, lake).read(spark, "cells").collect()
    assert sorted(r.chunk_id for r in cells) == ids
    by_id = {r.chunk_id: r.cell for r in cells}
    assert by_id["c0"] == by_id["c1"] != by_id["c2"]


def test_stream_follows_a_directory(spark, make_chunks, tmp_path):
    lake = LakeConfig(str(tmp_path / "lake"), 2, 2)
    incoming, state = str(tmp_path / "incoming"), str(tmp_path / "state")
    first, second = texts(21, range(6)), texts(22, range(3, 9))
    for part in (first, second):
        make_chunks(part).coalesce(1).write.mode("append").json(incoming)
        start_ingest_stream(spark, incoming, lake, state).awaitTermination()
    expected = index_rows(build_index(make_chunks({**first, **second})))
    assert index_rows(current(spark, lake).index(spark)) == expected


def test_chunks_and_vectors_meet_in_either_order(spark, make_chunks, tmp_path):
    lake = LakeConfig(str(tmp_path / "lake"), chunk_buckets=2, term_buckets=2)
    chunk_files, shard_files = tmp_path / "chunks", tmp_path / "shards"

    def chunks_arrive(texts):
        make_chunks(texts).write.mode("append").json(str(chunk_files))
        start_ingest_stream(spark, str(chunk_files), lake, str(tmp_path / "c")).awaitTermination()

    def vectors_arrive(shard, ids):
        folder = shard_files / "m" / shard
        folder.mkdir(parents=True)
        np.save(folder / "embeddings.npy", np.full((len(ids), 2), 3.0, dtype=np.float32))
        (folder / "chunk_ids.json").write_text(json.dumps(ids))
        start_vector_stream(spark, str(shard_files), "m", lake, str(tmp_path / "v")).awaitTermination()

    def wide():
        return sorted(row["chunk_id"] for row in current(spark, lake).rows(spark, "wide").collect())

    chunks_arrive({"a": "flood map", "b": "river"})
    assert wide() == []
    vectors_arrive("s1", ["a", "late"])
    assert wide() == ["a"]
    chunks_arrive({"late": "flood", "c": "alpha"})
    assert wide() == ["a", "late"]
    vectors_arrive("s2", ["c", "nobody"])
    assert wide() == ["a", "c", "late"]
    expected = build_index(make_chunks({"a": "flood map", "b": "river", "late": "flood", "c": "alpha"}))
    assert index_rows(current(spark, lake).index(spark)) == index_rows(expected)
    vectors = {r["chunk_id"]: r["embedding"] for r in current(spark, lake).rows(spark, "wide").collect()}
    assert vectors["late"] == pytest.approx([2**-0.5, 2**-0.5])


def test_text_lookup_reads_the_buckets_of_its_hits(spark, make_chunks, tmp_path, plan_text):
    from seekloom.operators.keyword import attach_text
    from seekloom.plans.scratch import written

    lake = LakeConfig(str(tmp_path / "lake"), 4, 2)
    ingest(spark, lake, make_chunks(texts(3, range(12))), update_keyword_index=False)
    table = current(spark, lake).read(spark, "chunks")
    hits = written(spark.createDataFrame([(1, "c3"), (2, "no")], "query_id long, chunk_id string"), "h")
    found = attach_text(hits, table, lake.chunk_buckets)
    plan = plan_text(found)
    assert any("dynamicpruningexpression(chunk_bucket" in line for line in plan.splitlines())
    assert {r.chunk_id: r.source_file for r in found.collect()} == {"c3": "/d/c3.txt", "no": None}


def test_ask_from_a_lake(spark, make_chunks, tmp_path):
    from seekloom.operators.embed import embed_hashed
    from seekloom.plans.answers import ask, query_table

    lake = LakeConfig(str(tmp_path / "lake"), 2, 2)
    chunks = make_chunks({"a": "flood map of the river", "b": "fema county homes", "c": "alpha"})
    embeddings = embed_hashed(chunks, 16, "text", "embedding").select("chunk_id", "embedding")
    ingest(spark, lake, chunks, embeddings)
    queries = query_table(spark, ["fema homes", "flood of the river"])

    def factory():
        return lambda messages: messages[1]["content"].split("[1] ")[1].split("\n")[0]

    with pytest.raises(ValueError):
        ask(spark, lake, queries, factory)
    ranked, answers = ask(spark, lake, queries, factory, embed=lambda q: embed_hashed(q, 16))
    assert {r.query_id: r.answer for r in answers.collect()} == {
        1: "fema county homes", 2: "flood map of the river",
    }
    first = ranked.filter("query_id = 1 and rerank_rank = 1").first()
    assert (first.chunk_id, first.source_tag, first.rerank_score) == ("b", "KW+VEC", 1.0)


def test_audits(spark, make_chunks):
    chunks = make_chunks({"c1": "a", "c2": "b", "c3": "c"})
    embeddings = vectors(spark, ["c2", "c3", "c4"])
    wide = chunks.join(embeddings, "chunk_id")
    source = chunks.select("chunk_id").unionByName(
        spark.createDataFrame([("c2",), ("zz",), (None,)], "chunk_id string")
    )
    tables = {"in_text": chunks, "in_emb": embeddings, "in_wide": wide}
    one_pass = coverage(source, tables).first().asDict()
    assert one_pass == {"total": 6, "in_text": 4, "in_emb": 3, "in_wide": 3}
    assert coverage_sql(source, chunks, embeddings, wide).first().asDict() == one_pass
    assert match_audit(chunks, embeddings).first().asDict() == {
        "chunks": 3, "embeddings": 3, "matched": 2,
    }
    assert source_files(chunks.withColumn("source_file", F.lit("/x/y.txt"))).count() == 1


def test_chunks_of_a_skipped_update_are_indexed_later(spark, make_chunks, tmp_path):
    lake = LakeConfig(str(tmp_path / "lake"), chunk_buckets=2, term_buckets=2)
    ingest(spark, lake, make_chunks({"a": "flood map", "b": "river flood"}))
    ingest(spark, lake, make_chunks({"c": "flood gauge", "a": "storm map"}), update_keyword_index=False)
    ingest(spark, lake, make_chunks({"d": "storm surge"}))
    found = {row["term"]: row["df"] for row in current(spark, lake).rows(spark, "df").collect()}
    assert found == {"storm": 2, "map": 1, "river": 1, "flood": 2, "gauge": 1, "surge": 1}
    assert current(spark, lake).rows(spark, "doc_stats").count() == 4


def test_compaction_bounds_partitions_and_frees_old_versions(spark, make_chunks, tmp_path):
    from seekloom.sources.snapshots import compact, remove_superseded, versions

    lake = LakeConfig(str(tmp_path / "lake"), chunk_buckets=2, term_buckets=2)
    for turn in range(4):
        ingest(spark, lake, make_chunks({f"n{turn}": f"flood number{turn}", "x": f"text{turn} here"}))
    before = current(spark, lake)
    rows = sorted(map(tuple, before.rows(spark, "postings").collect()))
    after = compact(spark, lake)
    assert sorted(map(tuple, after.rows(spark, "postings").collect())) == rows
    assert all(len(after.partitions(name)) <= 2 for name in ("chunks", "postings", "doc_stats"))
    assert remove_superseded(spark, lake) > 0
    assert versions(spark, lake) == [after.version]
    assert sorted(map(tuple, current(spark, lake).rows(spark, "postings").collect())) == rows


def folder_bytes(path):
    return sum(file.stat().st_size for file in path.rglob("*.parquet"))


def test_frequencies_grow_by_what_a_batch_changes(spark, make_chunks, tmp_path):
    """A batch writes as many bytes of df and meta in a lake fifty times as large."""
    written_bytes, jobs = [], []
    batch = make_chunks({f"n{i}": f"flood river new{i}" for i in range(5)} | {"c1": "flood map"})
    for size in (40, 2000):
        root = tmp_path / f"lake{size}"
        lake = LakeConfig(str(root), chunk_buckets=2, term_buckets=2)
        texts = {f"c{i}": f"flood word{i} other{i} common" for i in range(size)}
        ingest(spark, lake, make_chunks(texts))
        spark.sparkContext.setJobGroup(f"batch-{size}", "one batch")
        report = ingest(spark, lake, batch).first()
        spark.sparkContext.setJobGroup("rest", "")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batch-{size}")))
        assert (report["chunks_text"], report["affected_chunks"], report["new_postings"]) == (6, 6, 17)
        assert report["df_terms_changed"] == 11 and report["embeddings"] == report["wide"] == 0
        written_bytes.append([folder_bytes(root / name / "gen=2") for name in ("df", "meta")])
        after = current(spark, lake)
        expected = index_rows(build_index(make_chunks(texts | {r["chunk_id"]: r["text"] for r in batch.collect()})))
        assert index_rows(after.index(spark)) == expected
        assert len(after.partitions("df")) == 2 and len(compact(spark, lake).partitions("df")) == 1
        assert index_rows(current(spark, lake).index(spark)) == expected
    assert written_bytes[0] == written_bytes[1]
    assert abs(jobs[0] - jobs[1]) <= 2


def test_queries_add_up_changes_of_their_terms_only(spark, make_chunks, make_queries, tmp_path, plan_text):
    lake = LakeConfig(str(tmp_path / "lake"), chunk_buckets=2, term_buckets=2)
    ingest(spark, lake, make_chunks({f"c{i}": f"flood river word{i}" for i in range(30)}))
    ingest(spark, lake, make_chunks({"c1": "flood map", "n": "river"}))
    index, queries = current(spark, lake).index(spark), make_queries("flood river word1 map", "nothing")
    loose = KeywordConfig(df_ratio_max=1.0, english_ratio_min=None)
    kept = select_terms(queries, index, Lexicon.from_terms(spark), loose)
    assert {r.term: r.df for r in kept.collect()} == {"flood": 30, "river": 30, "map": 1}
    plan = plan_text(kept)
    assert "dynamicpruningexpression(term_bucket" in plan and "LeftSemi" in plan


def test_cells_follow_their_model(spark, make_chunks, tmp_path):
    from seekloom.operators.vectors import fit_cells
    from seekloom.plans.ingest import stored_cell_model

    lake = LakeConfig(str(tmp_path / "lake"), chunk_buckets=2, term_buckets=2)
    vectors = spark.createDataFrame(
        [(f"c{i}", [float(i % 5), 1.0, float(i)]) for i in range(40)], "chunk_id string, embedding array<float>"
    )
    chunks = make_chunks({f"c{i}": f"text {i}" for i in range(40)})
    one, two = (fit_cells(vectors, n, seed=n) for n in (3, 4))
    ingest(spark, lake, chunks, vectors, cell_model=one)
    ingest(spark, lake, chunks.limit(0), vectors.limit(5), cell_model=two)
    snapshot = current(spark, lake)
    assert len(stored_cell_model(spark, snapshot).clusterCenters()) == 4
    assert snapshot.rows(spark, "cells").count() == 40


def test_a_batch_names_the_ids_it_replaces_and_rewrites_no_other_rows(spark, make_chunks, tmp_path):
    lake = LakeConfig(str(tmp_path / "lake"), chunk_buckets=2, term_buckets=2)
    merged = {**texts(1, range(40)), "gone": "flood river"}
    ingest(spark, lake, make_chunks(merged), vectors(spark, ["c0", "c1"], 1.0))
    batch = {**texts(2, range(3)), "gone": "12"}
    for version in (2, 3):
        ingest(spark, lake, make_chunks(batch), vectors(spark, ["c1", "new"], 5.0))
        merged |= batch
        now = current(spark, lake)
        new = spark.read.parquet(f"{lake.root}/postings/gen={version}").select("chunk_id").distinct()
        assert {("c0",)} <= set(rows(new)) <= {("c0",), ("c1",), ("c2",)}
        assert rows(now.rows(spark, "chunks").select("chunk_id", "text")) == sorted(merged.items())
        assert index_rows(now.index(spark)) == index_rows(build_index(make_chunks(merged)))
        assert rows(now.rows(spark, "wide").select("chunk_id")) == [("c0",), ("c1",)]
    assert now.replacing("postings") == {(2, -2), (3, -2)}
    from seekloom.sources.snapshots import remove_superseded

    after = compact(spark, lake)
    assert not any(after.replacing(name) for name in ("chunks", "postings", "doc_stats", "wide"))
    assert index_rows(after.index(spark)) == index_rows(build_index(make_chunks(merged)))
    remove_superseded(spark, lake)
    assert not (tmp_path / "lake" / "postings_replaced" / "gen=2").exists()
    assert index_rows(current(spark, lake).index(spark)) == index_rows(build_index(make_chunks(merged)))


def test_many_replaced_ids_rewrite_partitions(spark, make_chunks, tmp_path, monkeypatch):
    from seekloom.sources import snapshots

    monkeypatch.setattr(snapshots, "keys_fit", lambda *_: False)
    lake = LakeConfig(str(tmp_path / "lake"), chunk_buckets=2, term_buckets=2)
    merged = texts(1, range(12))
    ingest(spark, lake, make_chunks(merged))
    batch = texts(2, range(3))
    ingest(spark, lake, make_chunks(batch))
    merged |= batch
    now = current(spark, lake)
    assert not now.replacing("postings") and not now.replacing("chunks")
    assert rows(now.rows(spark, "chunks").select("chunk_id", "text")) == sorted(merged.items())
    assert index_rows(now.index(spark)) == index_rows(build_index(make_chunks(merged)))


def test_postings_are_made_from_dealt_texts(spark, make_chunks, plan_text):
    from seekloom.operators.bm25_index import arrange_postings, deal_chunks, postings

    held = make_chunks(texts(3, range(60)))
    for task_bytes, tasks in ((10**9, 1), (500, None)):
        dealt = deal_chunks(held, 2, task_bytes)
        arranged = arrange_postings(postings(dealt), 2, 3)
        assert "rebalance" not in plan_text(arranged).lower()
        assert tasks is None or dealt.rdd.getNumPartitions() == tasks
        placed = dealt.select("chunk_id", F.spark_partition_id().alias("at"))
        bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(2))
        mixed = placed.groupBy("at").agg(F.count_distinct(bucket).alias("buckets")).agg(F.max("buckets")).first()[0]
        assert mixed <= (2 if tasks else 1)
        assert rows(arranged.select("term", "chunk_id", "tf")) == rows(postings(held).select("term", "chunk_id", "tf"))


def stored_tables(spark):
    from pathlib import Path

    from seekloom.plans.scratch import scratch_root

    return {path.name for path in Path(scratch_root(spark).removeprefix("file:")).iterdir()}


def test_an_ingest_leaves_no_scratch_tables(spark, make_chunks, tmp_path):
    lake = LakeConfig(str(tmp_path / "lake"), chunk_buckets=2, term_buckets=2)
    before = stored_tables(spark)
    for version in (1, 2):
        report = ingest(spark, lake, make_chunks(texts(version, range(4))))
    assert stored_tables(spark) <= before
    assert report.first()["affected_chunks"] == 4
    expected = index_rows(build_index(make_chunks(texts(2, range(4)))))
    assert index_rows(current(spark, lake).index(spark)) == expected


def test_a_written_frame_leaves_no_shuffle_files(spark):
    import time

    from seekloom.plans.scratch import written

    def shuffle_files():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if "shuffle_" in files.apply(i).getName()}

    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("part")).agg(F.sum("id").alias("total"))
    before = shuffle_files()
    stored = written(frame, "shuffled")
    for _ in range(100):
        if not (left := shuffle_files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert rows(stored) == rows(frame)


def test_compaction_shuffles_a_group_of_buckets_at_a_time(spark, make_chunks, tmp_path, monkeypatch):
    from seekloom.sources import snapshots

    lake = LakeConfig(str(tmp_path / "lake"), chunk_buckets=3, term_buckets=2)
    merged = {}
    for version in (1, 2):
        batch = texts(version, range(version * 3, version * 3 + 9))
        merged |= batch
        ingest(spark, lake, make_chunks(batch))
    held, replace_rows = [], snapshots.replace_rows

    def watched(spark, snapshot, table, ids, new_rows, *rest, **named):
        held.append(new_rows.select(F.pmod(F.xxhash64("chunk_id"), F.lit(3))).distinct().count())
        return replace_rows(spark, snapshot, table, ids, new_rows, *rest, **named)

    monkeypatch.setattr(snapshots, "replace_rows", watched)
    after = compact(spark, lake)
    assert max(held) == 1
    assert len({gen for gen, _ in after.partitions("postings")}) == 1
    assert rows(after.rows(spark, "chunks").select("chunk_id", "text")) == sorted(merged.items())
    assert index_rows(after.index(spark)) == index_rows(build_index(make_chunks(merged)))
