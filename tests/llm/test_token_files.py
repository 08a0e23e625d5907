from __future__ import annotations

import struct
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seekloom.llm import token_files
from seekloom.llm.queries import byte_bpe_path

TRICKY = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb c", "x \ny", "end.\nNext, it's 12. ok",
    "tab\tand space  \n  x", "don't stop.Now", "İ é.. ?!", "a\n", "\na", "<|endoftext|> b",
    "w1,w2 3.5. x", "²³. a²,", "a  b  c", "日本語 テキスト。 x", "a\r\nb", "\x1c a\x1c b",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(byte_bpe_path())


def whole(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def split_ids(encoder, text):
    data = encoder.encode([text])[0]
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_pieces_give_the_ids_of_the_whole_text(tokenizer):
    encoder = token_files.PieceEncoder(byte_bpe_path())
    for text in TRICKY + [" ".join(TRICKY), "\n".join(TRICKY)]:
        assert split_ids(encoder, text) == whole(tokenizer, text), repr(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1.,'é \n\t !s²", max_size=40))
def test_pieces_give_the_ids_of_any_text(text):
    encoder = token_files._encoder(byte_bpe_path())
    assert split_ids(encoder, text) == whole(encoder._tokenizer, text)


def test_what_an_encoder_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "PIECE_CACHE", 50)
    encoder = token_files.PieceEncoder(byte_bpe_path())
    whole_text = encoder._tokenizer
    for at in range(20):
        texts = [f"word{at}x{n} {'long' * 9}{n}, tab\there{n} {'y' * 40}. a,\nb{n}." for n in range(10)] * 2
        for text in texts:
            assert split_ids(encoder, text) == whole(whole_text, text)
        known = [*encoder._head, *encoder._tail]
        assert max(map(len, known)) <= token_files.LONGEST_PIECE and len(known) < 200


def test_round_trip_against_brute_force(spark, make_docs, tmp_path, tokenizer):
    rows = [(7, "the cat sat.\nOn it"), (2, None), (None, "null id"), (5, ""), (5, "b a"), (5, "b a")]
    rows += [(100 + i, text) for i, text in enumerate(TRICKY)] + [(90, "long word " * 30_000)]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(token_files.encode_documents(make_docs(rows), byte_bpe_path()), path)
    found = sorted(
        (tuple(row) for row in token_files.token_digests(spark, path).collect()), key=lambda r: r[1]
    )
    assert [row[0] for row in found] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(text or "")
    start = 0
    for doc_id, begin, count, crc in found:
        assert begin == start
        start += count
        sums = set()
        for text in texts[doc_id]:
            ids = [*whole(tokenizer, text), 0]
            sums.add((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        assert (count, crc) in sums
    some = token_files.read_tokens(spark, path, 5, 7).collect()
    assert sorted(row["doc_id"] for row in some) == [5, 5, 5, 7]
    index = token_files.read_index(spark, path).collect()
    assert sorted(row["start"] for row in index) == [row[1] for row in found]


def test_empty_table(spark, make_docs, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_tokens(token_files.encode_documents(make_docs([]), byte_bpe_path()), path)
    assert token_files.token_digests(spark, path).count() == 0


def test_encodings_and_page_index(make_docs, tmp_path):
    path = str(tmp_path / "laid_out")
    rows = [(i, f"some words {i} of it") for i in range(2000)]
    token_files.write_tokens(token_files.encode_documents(make_docs(rows), byte_bpe_path()), path)
    found = duckdb.sql(
        f"SELECT path_in_schema, encodings FROM parquet_metadata('{path}/*.parquet')"
    ).fetchall()
    encodings = {name: text for name, text in found}
    assert any("DICTIONARY" in text for name, text in encodings.items() if "tokens" in name)
    assert "DELTA_BINARY_PACKED" in encodings["n_tokens"]


def test_a_piece_is_encoded_once_and_long_ones_are_not_kept():
    encoder = token_files.PieceEncoder(byte_bpe_path())
    asked = []

    class Counting:
        def __init__(self, model):
            self._model = model

        def tokenize(self, piece):
            asked.append(piece)
            return self._model.tokenize(piece)

    for pieces in (encoder._head, encoder._tail):
        pieces._model = Counting(pieces._model)
    long = "x" * 40
    encoder.encode([f"some words, some words. {long} words"] * 3)
    assert sorted(asked) == sorted(["some", "\u0120some", "\u0120words", *["\u0120" + long] * 3])
    assert long not in encoder._tail


def test_pieces_asked_for_again_outlive_the_others(monkeypatch):
    monkeypatch.setattr(token_files, "PIECE_CACHE", 80)
    encoder = token_files.PieceEncoder(byte_bpe_path())
    asked = []
    encode = token_files._Pieces._encode
    monkeypatch.setattr(token_files._Pieces, "_encode", lambda self, text: asked.append(text) or encode(self, text))
    for at in range(60):
        text = f"start often4 {' '.join(f'rare{at}x{n}' for n in range(10))}"
        assert split_ids(encoder, text) == whole(encoder._tokenizer, text)
        assert len(encoder._tail) + len(encoder._tail._older) <= 80 + 22
    assert asked.count(" often4") == 1 and len(asked) == 601


def test_a_line_with_other_white_space_is_cut_as_the_tokenizer_does(tokenizer):
    encoder = token_files.PieceEncoder(byte_bpe_path(), pieces=10)
    for text in ("a  b", " a b", "a b ", "a\u00a0b c", "a\tb c", "a\u2028b c\u180e d", "plain words here", "é è 漢 字"):
        assert split_ids(encoder, text) == whole(tokenizer, text), repr(text)
