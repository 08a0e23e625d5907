from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seekloom.llm import token_alignment
from seekloom.llm.queries import byte_bpe_path, piece_bpe_path

TRICKY = [
    "the cat sat on the mat", "a  b   c", " lead", "trail ", "\n", " ", "tab\tx\ny \n z", "don't stop.Now 12,345 e-mail",
    "İé ﬁ ａ 日本語 テキスト 😀 x", "▁x a▁b", "a\x00b", "<|endoftext|> <s> x</s> <unk> <0x41>", "　x y z",
    "unbelievably antidisestablishmentarianism Schifffahrtsgesellschaft", "x" * 300, "12345678901234567890 " * 3, "é ö",
]


def spelled():
    """The bytes of each token, from the vocabularies alone."""
    signs = {*range(33, 127), *range(161, 173), *range(174, 256)}
    alphabet, extra = {}, 0
    for byte in range(256):
        if byte in signs:
            alphabet[chr(byte)] = byte
        else:
            alphabet[chr(256 + extra)] = byte
            extra += 1
    vocabulary = json.load(open(byte_bpe_path()))["model"]["vocab"]
    a = {at: bytes(alphabet[c] for c in t) for t, at in vocabulary.items() if all(c in alphabet for c in t)}
    model = sentencepiece.SentencePieceProcessor(model_file=piece_bpe_path())
    b = {}
    for at in range(model.get_piece_size()):
        piece = model.id_to_piece(at)
        b[at] = bytes([int(piece[1:-1], 16)]) if model.is_byte(at) else piece.replace("▁", " ").encode()
    return a, b


@pytest.fixture(scope="module")
def brute():
    tokenizer = Tokenizer.from_file(byte_bpe_path())
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=piece_bpe_path())
    bytes_a, bytes_b = spelled()

    def align(text):
        """Ids, groups and links by comparing every pair of tokens' byte ranges."""
        if not text:
            return [], [], [], []
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        content = (" " + text).encode()
        if b"".join(bytes_a[x] for x in a) != content or b"".join(bytes_b[x] for x in b) != content:
            return [], [], [], []

        def spans(ids, table):
            at, found = 0, []
            for x in ids:
                found.append((at, at + len(table[x])))
                at = found[-1][1]
            return found

        one, other = spans(a, bytes_a), spans(b, bytes_b)
        cuts = sorted({end for _, end in one} & {end for _, end in other})
        groups, low = [], 0
        for cut in cuts:
            groups.append(
                ",".join(str(x) for x, s in zip(a, one, strict=True) if low <= s[0] < cut)
                + "|"
                + ",".join(str(x) for x, s in zip(b, other, strict=True) if low <= s[0] < cut)
            )
            low = cut
        links = [
            (x, y) for x, s in zip(a, one, strict=True) for y, t in zip(b, other, strict=True)
            if s[0] < t[1] and t[0] < s[1]
        ]
        return a, b, groups, links

    return align


def aligner():
    return token_alignment._aligner(byte_bpe_path(), piece_bpe_path())


def same(found, want):
    a, b, groups, links = want
    counted = Counter(x * token_alignment.PAIR_BASE + y for x, y in links)
    assert (found.n_a, found.n_b, found.n_groups, found.n_links) == (len(a), len(b), len(groups), len(links))
    assert found.groups == ";".join(groups)
    assert dict(zip(found.pairs.tolist(), found.times.tolist(), strict=True)) == counted


def test_alignment_of_tricky_texts(brute):
    texts = [*TRICKY, " ".join(TRICKY[:8]), *TRICKY]
    for text, found in zip(texts, aligner().documents([t.encode() for t in texts]), strict=True):
        same(found, brute(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeht1.,'é▁ \n\t日　", max_size=40))
def test_alignment_of_any_text(brute, text):
    same(next(aligner().documents([text.encode()])), brute(text))


def test_sliced_texts_have_the_tokens_of_the_whole(brute, monkeypatch):
    monkeypatch.setattr(token_alignment, "SLICE_CHARS", 25)
    monkeypatch.setattr(token_alignment, "MEMO_WORDS", 5)
    texts = [" ".join(TRICKY[k:] + TRICKY[:k]).replace("▁", "_") for k in range(len(TRICKY))] + ["a▁b " + "x y " * 30]
    for text, found in zip(texts, aligner().documents([t.encode() for t in texts]), strict=True):
        same(found, brute(text))


def test_windows_of_equal_hashes_are_told_apart(monkeypatch, brute):
    monkeypatch.setattr(token_alignment, "mix", lambda values: values & np.uint64(1))
    text = " ".join(TRICKY[:3] + TRICKY[5:8] + TRICKY[13:])
    same(next(aligner().documents([text.encode()])), brute(text))


def test_table_against_brute_force(make_docs, brute):
    rows = [(1, None), (2, ""), (None, "the cat"), (3, "the cat sat"), (3, "the cat sat"), (4, "a▁b")]
    rows += [(at + 10, text) for at, text in enumerate(TRICKY)] + [(90, "long words here " * 90)]
    aligned = [(doc_id, *brute(text)) for doc_id, text in rows]
    counts, best, want = Counter(pair for *_, links in aligned for pair in links), {}, []
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for doc_id, a, b, groups, links in aligned:
        n_best = sum(counts[pair] == best[pair[1]] for pair in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        total = sum(counts[pair] for pair in links)
        want.append((doc_id, len(a), len(b), len(groups), len(links), n_best, total, digest))
    found = token_alignment.alignment_digests(make_docs(rows), byte_bpe_path(), piece_bpe_path())
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(row[name] for name in names) for row in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table_and_broken_text(spark, make_docs):
    found = token_alignment.alignment_digests(make_docs([]), byte_bpe_path(), piece_bpe_path())
    assert found.count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF' AS string) AS text")
    row = token_alignment.align_documents(broken, byte_bpe_path(), piece_bpe_path()).first()
    assert (row["n_a"], row["groups"], row["pairs"]) == (0, "", [])


def test_very_long_texts_keep_time_in_proportion():
    words = "some words of a very long text, 12 of them\n" * 60_000
    found = next(aligner().documents([words.encode()]))
    assert found.n_groups > 500_000 and found.n_links == found.n_a + found.n_b - found.n_groups
