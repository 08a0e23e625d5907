"""Alignment of the tokens of two tokenizers by shared ends before space-marked tokens.

Both tokenizers encode the whole text, frequent words from memory; their tokens are laid over the same bytes. A byte
offset where tokens of both end and the next token of both starts with a space is an anchor.
Anchors cut a document into windows of a word or a few, and equal windows, as tuples of token
ids, have the same alignment wherever they stand. So each window's alignment is worked out once
and remembered, within a bound on the memory. An alignment cuts a window at every shared end
into groups; the tokens of a group overlap like two partitions of a stretch without a common
inner end.

How often two ids overlap in the corpus is a sum over the documents' own counts of pairs.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekloom.llm.hashing import mix
from seekloom.llm.token_files import SPACE_CUT
from seekloom.plans.scratch import written
from seekloom.plans.sizing import hinted, keys_fit

MEMO_WORDS = 500_000  # words whose tokens a worker remembers before it starts afresh
LONGEST_WORD = 48  # characters of a word beyond which it is not remembered
SLICE_CHARS = 2_500_000  # text that is aligned at a time
PAIR_BASE = 1 << 24  # a pair of ids is kept as a * PAIR_BASE + b

_SCHEMA = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary,"
    " pairs array<long>, times array<int>"
)
_ARROW = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
)


def _byte_of_sign() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for, by its rule."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [byte for byte in range(256) if byte not in visible]
    return {chr(byte): byte for byte in visible} | {chr(256 + at): byte for at, byte in enumerate(rest)}


def _slices(text: str, limit: int) -> Iterator[str]:
    """A text in pieces of about ``limit`` characters, cut at single spaces, which are left out.

    Both tokenizers cut before such a space whatever surrounds it, so the pieces, each with a
    space before it, have the tokens of the whole, and each cut is an anchor. A text without
    such a place is one piece.
    """
    begin = 0
    while len(text) - begin > limit and (cut := SPACE_CUT.search(text, begin + limit)):
        yield text[begin : cut.start()]
        begin = cut.end()
    yield text[begin:]


class ByteLevelTokens:
    """Tokens of space+text under a byte-level BPE vocabulary, special tokens' strings as plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        signs, vocabulary = _byte_of_sign(), self._tokenizer.get_vocab()
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, at in vocabulary.items():
            known = all(sign in signs for sign in token)
            self.token_bytes[at] = bytes(signs[sign] for sign in token) if known else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text, a space before it."""
        texts = [" " + text for text in texts]
        return [one.ids for one in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """Tokens of a text under a piece vocabulary, whose encoder puts a space before it."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.token_bytes: list[bytes] = []
        self.cuts_at_spaces = True  # no piece goes on behind a space
        for at in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(at)
            if self._model.is_byte(at):
                self.token_bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.token_bytes.append(piece.replace("▁", " ").encode())
                self.cuts_at_spaces &= "▁" not in piece.lstrip("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text; the space before it is the encoder's own."""
        return self._model.encode(texts, num_threads=1)


@dataclass
class Windows:
    """Alignments of windows: the text and number of each one's groups, and its linked id pairs.

    The pairs of window ``w`` are ``links[first[w] : first[w] + size[w]]``.
    """

    groups: np.ndarray
    count: np.ndarray
    links: np.ndarray
    first: np.ndarray
    size: np.ndarray


@functools.lru_cache(maxsize=1)
def _numerals(count: int) -> dict[str, np.ndarray]:
    """The ids below ``count`` as decimal text, with each mark that may follow them."""
    return {mark: np.array([f"{at}{mark}" for at in range(count)], dtype=object) for mark in ",|;\n"}


def align_windows(
    a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray,
    length_a: np.ndarray, length_b: np.ndarray,
) -> Windows:
    """Cut windows, given one after the other, at the shared ends of their tokens and link what overlaps."""
    ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    # Between two ends that follow each other lies one link.
    ends = np.union1d(ends_a, ends_b)
    at, to = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    links = a[at].astype(np.int64) * PAIR_BASE + b[to]
    size = np.bincount(np.repeat(np.arange(len(sizes_a)), sizes_a)[at], minlength=len(sizes_a))
    shared_a = ends_a == ends_b[np.searchsorted(ends_b, ends_a)]
    shared_b = ends_b == ends_a[np.searchsorted(ends_a, ends_b)]
    last_a, last_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    count = np.add.reduceat(shared_a.astype(np.int64), last_a - sizes_a)
    # The tokens of a group: first those of A, then those of B.
    group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
    text = _numerals(max(len(length_a), len(length_b)))
    shown = np.empty(len(a) + len(b), dtype=object)
    own = text[","][a]
    own[shared_a] = text["|"][a[shared_a]]
    shown[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = own
    own = text[","][b]
    own[shared_b] = text[";"][b[shared_b]]
    own[last_b - 1] = text["\n"][b[last_b - 1]]
    shown[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = own
    groups = np.array("".join(shown.tolist()).split("\n")[:-1], dtype=object)
    return Windows(groups, count, links, np.cumsum(size) - size, size)


@dataclass
class Aligned:
    """A document's tokens and their alignment; without tokens all is empty."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


class Aligner:
    """Align the tokens of two tokenizers, each different window of a batch once."""

    def __init__(self, first: ByteLevelTokens, second: PieceTokens) -> None:
        self._first, self._second = first, second
        self._length_a = np.array([len(token) for token in first.token_bytes])
        self._length_b = np.array([len(token) for token in second.token_bytes])
        self._space_a = np.array([token[:1] == b" " for token in first.token_bytes])
        self._space_b = np.array([token[:1] == b" " for token in second.token_bytes])
        self._words_a: dict[str, bytes] = {}
        self._words_b: dict[str, bytes] = {}
        self._odd: set[str] = set()  # words whose tokens have other bytes

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each text under both tokenizers, a space before it, or none if they do not spell it.

        A text is encoded word by word where it can be cut; words that came before keep their ids.
        Words are compared with their tokens' bytes once, and texts only if one of their words differs.
        """
        words = [SPACE_CUT.split(text) if self._second.cuts_at_spaces else [text] for text in texts]
        if len(self._words_a) > MEMO_WORDS:
            self._words_a, self._words_b, self._odd = {}, {}, set()
        missing = list(set().union(*words).difference(self._words_a))
        for at in range(0, len(missing), 2000):
            some = missing[at : at + 2000]
            for word, a, b in zip(some, self._first.encode(some), self._second.encode(some), strict=True):
                if not self._spelled(a, b, b" " + word.encode()):
                    self._odd.add(word)
                self._words_a[word] = _packed_ids(a)
                self._words_b[word] = _packed_ids(b)
        found = tuple(
            [np.frombuffer(b"".join(map(known.__getitem__, some)), np.int32) for some in words]
            for known in (self._words_a, self._words_b)
        )
        for at, some in enumerate(words):
            if not self._odd.isdisjoint(some):
                a, b = (side[at].tolist() for side in found)
                if not self._spelled(a, b, b" " + texts[at].encode()):
                    found[0][at] = found[1][at] = np.empty(0, np.int32)
        for word in missing:
            if len(word) > LONGEST_WORD:
                del self._words_a[word], self._words_b[word]
                self._odd.discard(word)
        return found

    def _spelled(self, a: list[int], b: list[int], content: bytes) -> bool:
        """Whether both token sequences have the bytes of the content."""
        one, other = self._first.token_bytes, self._second.token_bytes
        return b"".join([one[at] for at in a]) == content == b"".join([other[at] for at in b])

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers after shared ends, where both next tokens start with a space, and the last ends."""
        ends_a, ends_b = np.cumsum(self._length_a[a]), np.cumsum(self._length_b[b])
        place = np.searchsorted(ends_b, ends_a[:-1])
        shared = ends_b[place] == ends_a[:-1]
        shared &= self._space_a[a[1:]]
        at = np.flatnonzero(shared)
        to = place[at]
        spaced = self._space_b[b[to + 1]]
        return np.append(at[spaced] + 1, len(a)), np.append(to[spaced] + 1, len(b))

    def align(self, texts: list[str]) -> list[Aligned]:
        """The alignment of each text, all empty where a tokenizer does not spell it."""
        found = [Aligned()] * len(texts)
        tokens = zip(range(len(texts)), *self.tokens(texts), strict=True)
        good = [(at, a, b) for at, a, b in tokens if texts[at] and len(a)]
        if not good:
            return found
        numbers, all_a, all_b = zip(*good, strict=True)
        a, b = np.concatenate(all_a), np.concatenate(all_b)
        # A text starts with a space, so its beginning is an anchor like those inside.
        cuts_a, cuts_b = self.anchors(a, b)
        starts_a, starts_b = np.append(0, cuts_a[:-1]), np.append(0, cuts_b[:-1])
        same, fresh = _equal_windows(a, starts_a, cuts_a, b, starts_b, cuts_b)
        sizes_a, sizes_b = cuts_a - starts_a, cuts_b - starts_b
        windows = align_windows(
            a[_stretches(starts_a[fresh], sizes_a[fresh])], sizes_a[fresh],
            b[_stretches(starts_b[fresh], sizes_b[fresh])], sizes_b[fresh],
            self._length_a, self._length_b,
        )
        counts, shown, held = windows.count[same], windows.groups[same], windows.size[same]
        links = windows.links[_stretches(windows.first[same], held)]
        ends = np.searchsorted(cuts_a, np.cumsum([len(one) for one in all_a])) + 1
        bounds = np.concatenate([[0], np.cumsum(held)])[np.append(0, ends)]
        begin = 0
        for at, (number, end) in enumerate(zip(numbers, ends.tolist(), strict=True)):
            pairs, times = np.unique(links[bounds[at] : bounds[at + 1]], return_counts=True)
            found[number] = Aligned(
                len(all_a[at]), len(all_b[at]), int(counts[begin:end].sum()),
                int(held[begin:end].sum()), ";".join(shown[begin:end].tolist()), pairs, times,
            )
            begin = end
        return found

    def documents(self, texts: list[bytes | None]) -> Iterator[Aligned]:
        """The alignment of each text, worked on in batches of bounded size."""
        waiting: list[str] = []
        held = 0
        for text in texts:
            try:
                plain = (text or b"").decode()
            except UnicodeDecodeError:
                plain = ""  # no tokens have the bytes of such a text
            if len(plain) <= SLICE_CHARS or not self._second.cuts_at_spaces:
                waiting.append(plain)
                held += len(plain)
                if held >= SLICE_CHARS:
                    yield from self.align(waiting)
                    waiting, held = [], 0
                continue
            yield from self.align(waiting)
            waiting, held = [], 0
            yield _merged([self.align([piece])[0] for piece in _slices(plain, SLICE_CHARS)])
        yield from self.align(waiting)


def _stretches(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``sizes`` of them, one stretch after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _equal_windows(
    a: np.ndarray, starts_a: np.ndarray, ends_a: np.ndarray,
    b: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """For each window the number of its kind, and of each kind one window.

    Windows are of a kind if all their ids are equal: they are grouped by a hash and then
    compared with the first of the group; one that differs from it is a kind of its own.
    """
    places, sums = [], np.zeros(len(starts_a), dtype=np.uint64)
    for ids, starts, ends in ((a, starts_a, ends_a), (b, starts_b, ends_b)):
        sizes = ends - starts
        at = np.arange(len(ids)) - np.repeat(starts, sizes)
        places.append((ids, starts, sizes, at))
        mixed = mix(ids.astype(np.uint64) + mix(at.astype(np.uint64)) + np.uint64(1))
        sums = mix(sums + np.add.reduceat(mixed, starts) + sizes.astype(np.uint64))
    _, first, same = np.unique(sums, return_index=True, return_inverse=True)
    equal = np.ones(len(starts_a), dtype=bool)
    for ids, starts, sizes, at in places:
        equal &= sizes == sizes[first[same]]
    for ids, starts, sizes, at in places:
        other = np.minimum(np.repeat(starts[first[same]], sizes) + at, len(ids) - 1)
        equal &= np.logical_and.reduceat(ids == ids[other], starts)
    odd = np.flatnonzero(~equal)
    same[odd] = len(first) + np.arange(len(odd))
    return same, np.append(first, odd)


def _packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def _merged(parts: list[Aligned]) -> Aligned:
    """A document from its pieces; if one of them has no tokens, neither has the document."""
    if not all(part.n_a for part in parts):
        return Aligned()
    pairs, inverse = np.unique(np.concatenate([part.pairs for part in parts]), return_inverse=True)
    times = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(times, inverse, np.concatenate([part.times for part in parts]))
    return Aligned(
        *(sum(getattr(part, name) for part in parts) for name in ("n_a", "n_b", "n_groups", "n_links")),
        ";".join(part.groups for part in parts),
        pairs,
        times,
    )


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(ByteLevelTokens(path_a), PieceTokens(path_b))


def _packed(ids: pa.Array, found: list[Aligned]) -> pa.RecordBatch:
    offsets = pa.array(np.cumsum([0] + [len(one.pairs) for one in found]), pa.int32())
    pairs = np.concatenate([one.pairs for one in found])
    times = np.concatenate([one.times for one in found]).astype(np.int32)
    arrays = [ids]
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        arrays.append(pa.array([getattr(one, name) for one in found], pa.int64()))
    arrays.append(pa.array([one.groups.encode() for one in found], pa.binary()))
    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())))
    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())))
    return pa.record_batch(arrays, schema=_ARROW)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times)`` of each text.

    ``path_a`` names a byte-level BPE vocabulary (a space is put before the text), ``path_b``
    a piece vocabulary. ``groups`` is the alignment as ``a1,a2|b1;a3|b2,b3`` with the ids in
    order; ``pairs`` are the different linked pairs as ``a * PAIR_BASE + b``, ``times`` how
    often the text links each. Texts that are null or empty, or that either tokenizer's
    tokens do not spell byte for byte, have no tokens: zeros and empty values. Null ids stay
    null; repeated rows are aligned each; other columns are ignored; an empty table gives no
    rows. A text longer than ``SLICE_CHARS`` is encoded in pieces with the same tokens.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            found: list[Aligned] = []
            begin, held = 0, 0
            for one in aligner.documents([text.as_py() for text in batch.column(1)]):
                found.append(one)
                held += len(one.groups) + 12 * len(one.pairs)
                if held >= 8_000_000:
                    yield _packed(batch.column(0).slice(begin, len(found)), found)
                    begin, found, held = begin + len(found), [], 0
            if found:
                yield _packed(batch.column(0).slice(begin, len(found)), found)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(align, _SCHEMA).withColumn("groups", F.col("groups").cast("string"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, n, best)`` of the stored alignments: links that hold a pair of ids, and the most of its ``b``."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("of"))
    counts = each.groupBy(F.col("of.pairs").alias("pair")).agg(F.sum("of.times").alias("n"))
    counts = written(
        counts.select(
            F.expr(f"pair div {PAIR_BASE}").alias("a"), F.expr(f"pair % {PAIR_BASE}").alias("b"), "n"
        ),
        "pair-counts",
    )
    tops = counts.groupBy("b").agg(F.max("n").alias("best"))
    return counts.join(tops, "b").select("a", "b", "n", "best")


def with_pair_counts(aligned: DataFrame) -> DataFrame:
    """The stored alignments, which have a unique ``row``, with ``n_best`` and ``count_sum``.

    ``n_best`` counts the links whose pair is as frequent in the corpus as any of its ``b``;
    ``count_sum`` adds up the frequencies of the pairs of all links.
    """
    counts = pair_counts(aligned)
    pair = (F.col("a") * PAIR_BASE + F.col("b")).alias("_pair")
    counts = written(counts.select(pair, "n", (F.col("n") == F.col("best")).alias("top")), "pair-ranks")
    each = aligned.select(
        F.col("row").alias("_row"), F.explode(F.arrays_zip("pairs", "times")).alias("of")
    ).select("_row", F.col("of.pairs").alias("pair"), F.col("of.times").cast("long").alias("held"))
    sums = (
        each.join(hinted(counts, keys_fit(counts, "_pair", "n")), F.col("pair") == F.col("_pair"))
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("top"), F.col("held")).otherwise(0)).alias("n_best"),
            F.sum(F.col("held") * F.col("n")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("long")
    return (
        aligned.join(sums, F.col("row") == F.col("_row"), "left")
        .drop("_row", "pairs", "times", "row")
        .withColumn("n_best", F.coalesce("n_best", zero))
        .withColumn("count_sum", F.coalesce("count_sum", zero))
    )


def alignment_digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document the sizes of its alignment, a digest of its groups and its links' corpus counts.

    The digest is the SHA-256 of ``groups`` in lower-case hex, empty for texts without tokens.
    """
    aligned = align_documents(docs, path_a, path_b)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    aligned = aligned.withColumn("groups_sha256", digest).drop("groups")
    return with_pair_counts(written(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned"))
