"""File layout readers on real files."""

from __future__ import annotations

import io
import json
import os

import numpy as np
import pytest

from seekloom.sources.chunks import list_lake, load_batch
from seekloom.sources import shards
from seekloom.sources.shards import read_embedding_shards

MODEL = "Model-1.5"


def write_shard(base, name, ids, vectors, model=MODEL):
    folder = os.path.join(base, "optimized_embeddings", model, name)
    os.makedirs(folder)
    np.save(os.path.join(folder, "embeddings.npy"), vectors)
    with open(os.path.join(folder, "chunk_ids.json"), "w", encoding="utf-8") as file:
        json.dump(ids, file)


@pytest.fixture
def lake(tmp_path):
    base = str(tmp_path)
    for part, ids in (("p1", ["a", "b"]), ("p2", ["c"])):
        folder = os.path.join(base, "optimized_chunks", part)
        os.makedirs(folder)
        with open(os.path.join(folder, "chunks.jsonl"), "w", encoding="utf-8") as file:
            for i, key in enumerate(ids):
                row = {
                    "chunk_id": key, "source_file": f"/d/{part}.txt", "chunk_index_in_file": i,
                    "text": f"text {key}", "extra": 1,
                }
                file.write(json.dumps(row) + "\n")
    write_shard(base, "s1", ["a", "b"], np.array([[1, 2], [3, 4]], dtype=np.float64))
    write_shard(base, "s2", ["c"], np.array([[5, 6]], dtype=np.float16))
    # A similar model name that a careless pattern would also match.
    write_shard(base, "s3", ["z"], np.ones((1, 2), dtype=np.float32), model="Model-1x5")
    return base


@pytest.mark.parametrize("slash", ["", "/"])
def test_load_batch(spark, lake, slash):
    chunks, embeddings = load_batch(spark, lake + slash, MODEL)
    assert {(r.chunk_id, r.source_file, r.chunk_index_in_file, r.text) for r in chunks.collect()} == {
        ("a", "/d/p1.txt", 0, "text a"), ("b", "/d/p1.txt", 1, "text b"), ("c", "/d/p2.txt", 0, "text c"),
    }
    assert {r.chunk_id: r.embedding for r in embeddings.collect()} == {
        "a": [1.0, 2.0], "b": [3.0, 4.0], "c": [5.0, 6.0],
    }
    assert embeddings.schema["embedding"].dataType.simpleString() == "array<float>"


def test_mismatched_shard_fails_or_truncates(spark, tmp_path):
    base = str(tmp_path)
    write_shard(base, "s1", ["a", "b"], np.ones((3, 2), dtype=np.float32))
    folder = os.path.join(base, "optimized_embeddings")
    with pytest.raises(Exception, match="2 ids, 3 vectors"):
        read_embedding_shards(spark, folder, MODEL).collect()
    assert read_embedding_shards(spark, folder, MODEL, on_mismatch="truncate").count() == 2
    with pytest.raises(ValueError):
        read_embedding_shards(spark, folder, MODEL, on_mismatch="ignore")


def test_list_lake_groups_files_by_directory(spark, lake):
    listing = {r.directory.split("/")[-1]: r.files for r in list_lake(spark, lake).collect()}
    assert listing["p1"] == 1 and listing["s1"] == 2


@pytest.mark.parametrize("order", ["C", "F"])
def test_shards_are_read_in_row_ranges(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(shards, "RANGE_BYTES", 7 * 3 * 8)
    monkeypatch.setattr(shards, "READ_BYTES", 11)
    monkeypatch.setattr(shards, "EMIT_ROWS", 2)
    base, rng = str(tmp_path), np.random.default_rng(1)
    want = {}
    for name, count in (("s1", 50), ("s2", 7), ("s3", 0), ("s4", 1)):
        ids = [f'{name}, "é{i}]' if i % 2 else f"{name}{i}" for i in range(count)]
        vectors = rng.normal(size=(count, 3))
        write_shard(base, name, ids, np.asarray(vectors, order=order))
        want |= {key: vectors[i].astype(np.float32).tolist() for i, key in enumerate(ids)}
    found = read_embedding_shards(spark, os.path.join(base, "optimized_embeddings"), MODEL)
    rows = found.collect()
    assert len(rows) == 58 and {r.chunk_id: r.embedding for r in rows} == want
    folder = f"file:{base}/optimized_embeddings/{MODEL}/s1"
    assert [(start, len(ids)) for start, ids in shards._ranges(folder, "fail")] == [
        (at, min(7, 50 - at)) for at in range(0, 50, 7)
    ]


def test_id_lists_are_read_piece_by_piece(monkeypatch):
    entries = ["a", "b,c", 'q"]', "é日", "", 12, 345678, -1.5, None, True]
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(shards, "READ_BYTES", size)
        for text in (json.dumps(entries), json.dumps(entries, ensure_ascii=False, indent=2), " [ ] "):
            want = [str(value) for value in json.loads(text)]
            assert list(shards.listed_ids(io.BytesIO(text.encode()))) == want
        for broken in ("[1, 2", "{}", ""):
            with pytest.raises(ValueError):
                list(shards.listed_ids(io.BytesIO(broken.encode())))


def test_a_matrix_above_two_gigabytes_needs_its_range_only(tmp_path):
    """A sparse file of 4 GB: only the rows asked for are read."""
    path, width = tmp_path / "embeddings.npy", 1024
    rows = 2**20 + 5
    header = io.BytesIO()
    np.lib.format.write_array_header_1_0(header, {"descr": "<f4", "fortran_order": False, "shape": (rows, width)})
    with open(path, "wb") as file:
        file.write(header.getvalue())
        file.truncate(len(header.getvalue()) + 4 * rows * width)
        file.seek(-4 * width, 2)
        file.write(np.arange(width, dtype="<f4").tobytes())
    with shards._opened(f"file:{path}") as file:
        layout = shards.matrix_layout(file)
        assert (layout.rows, layout.width) == (rows, width) and file.size() > 2**32
        last = layout.read(file, rows - 2, rows)
    assert not last[0].any() and last[1].tolist() == list(range(width))
