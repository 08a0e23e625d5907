from __future__ import annotations

import math
import struct
import zlib
from hashlib import md5

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seekloom.llm import cotraining
from seekloom.llm.queries import byte_bpe_path, table
from tests.llm.brute import jaccard_components, shingles, words

SF_DIR = "/root/testdata/sf0.001"


def plain_mix(rows):
    """``{doc_id: copies}`` of rows ``(doc_id, text, source)`` by the definition."""
    sizes = {doc_id: len(words(text)) for doc_id, text, _ in rows}
    sources = sorted({row[2] for row in rows if row[2] is not None}) + [None]
    held = {s: sum(sizes[row[0]] for row in rows if row[2] == s) for s in sources}
    sources = [s for s in sources if any(row[2] == s for row in rows)]
    weight = {s: at % 3 + 1 for at, s in enumerate(sources)}
    full, total = set(), sum(held.values())
    while True:
        rest = total - sum(3 * held[s] for s in full)
        unit = rest / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and unit * weight[s] > 3 * held[s]}
        if not more:
            break
        full |= more
    copies = {}
    for s in sources:
        target = float(3 * held[s]) if s in full else unit * weight[s]
        start = int(md5(f"mix|{s}".encode()).hexdigest()[:8], 16) / 4294967296.0
        each = target / held[s] if held[s] else 0.0
        own = sorted((sizes[row[0]], row[0]) for row in rows if row[2] == s)
        for n, (_, doc_id) in enumerate(own, start=1):
            copies[doc_id] = math.floor(each * n + start) - math.floor(each * (n - 1) + start)
    return copies


def plain_pipeline(spark):
    documents, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    scored = cotraining.quality_scores(documents, cotraining.good_labels(labels)).collect()
    good = {row["doc_id"] for row in scored if row["kept"]}
    rows = [row for row in documents.collect() if row["doc_id"] in good]
    classes = jaccard_components([(row["doc_id"], row["text"]) for row in rows])
    first = {doc_id for doc_id, _, component in classes if doc_id == component}
    items = [shingles(row["text"]) for row in table(spark, SF_DIR, "benchmark").collect()]

    def clean(text):
        own = shingles(text)
        return not any(100 * len(item & own) >= 75 * len(item) for item in items)

    rows = [(r["doc_id"], r["text"], r["source"]) for r in rows if r["doc_id"] in first and clean(r["text"])]
    copies = plain_mix(rows)
    tokenizer, start, out = Tokenizer.from_file(byte_bpe_path()), 0, []
    for doc_id, text, _ in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for _ in range(copies[doc_id]):
            out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            start += len(ids)
    return out


@pytest.mark.filterwarnings("ignore")
def test_equals_plain_version(spark):
    found = sorted(tuple(row) for row in corpus_pipeline.run(spark, SF_DIR).collect())
    assert found == sorted(plain_pipeline(spark))


def test_stages_keep_columns_and_take_any_rows(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (2, long), (2, long), (3, None), (4, ""), (None, long), (None, None), (5, "x " * 50_000)]
    docs = make_docs(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            found = stage(spark, frame, SF_DIR)
            assert found.columns == docs.columns, name
            assert found.count() <= 3 * frame.count()
    kept = [row["doc_id"] for row in corpus_pipeline.dedup(spark, docs, SF_DIR).collect()]
    assert sorted(kept, key=str) == [1, 3, 4, 5, None, None]
    assert corpus_pipeline.tokens(spark, docs, SF_DIR).count() == len(rows)


def test_dedup_keeps_one_of_repeated_rows(spark, make_docs):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (8, "other words of one more document")]
    kept = corpus_pipeline.dedup(spark, make_docs(rows), SF_DIR).collect()
    assert sorted(row["doc_id"] for row in kept) == [7, 8]


def test_stages_hand_texts_on_in_bounded_batches(spark, make_docs):
    name, most = corpus_pipeline._BATCH_BYTES, corpus_pipeline.BATCH_BYTES
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.column(1).nbytes])], names=["doc_id"])

    try:
        for held, bound in (("64m", most), ("1024", 1024), ("512kb", 512 << 10), ("67108864b", most)):
            spark.conf.set(name, held)
            corpus_pipeline.bounded_batches(spark)
            kept = spark.conf.get(name)
            assert kept in (held, f"{most}b", str(most)) and (held == kept) == (bound != most), (held, kept)
        spark.conf.set(name, "64m")
        docs = make_docs([(at, f"w{at} " * 20_000) for at in range(100)]).select("doc_id", "text").coalesce(1)
        corpus_pipeline.dedup(spark, make_docs([(1, "a b c"), (2, "a b c")]), "unused").count()
        found = [row["doc_id"] for row in docs.mapInArrow(sizes, "doc_id long").collect()]
        assert sum(found) > most and max(found) <= 2 * most
    finally:
        spark.conf.set(name, before)
