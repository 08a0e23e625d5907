"""Words, shingles and 64-bit hashes of texts, in NumPy."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

SHINGLE_WORDS = 5
# Odd multipliers for the words of a shingle and the finisher of splitmix64.
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; equal values stay equal and others differ."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D; A-Z in lower case."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    found = words(text)
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash of each 5-word shingle in order; fewer words are one shingle, none give none."""
    count = len(hashes) - SHINGLE_WORDS + 1
    if count >= 1:
        total = hashes[:count] * _PLACES[0]
        for place in range(1, SHINGLE_WORDS):
            total += mix(hashes[place : place + count]) * _PLACES[place]
        return mix(total)
    if len(hashes) == 0:
        return hashes
    total = (mix(hashes) * _PLACES[: len(hashes)]).sum(dtype=np.uint64)
    return mix(np.array([total + np.uint64(len(hashes))], dtype=np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(word_hashes(text)))


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as signed 64-bit integers, as Spark holds them."""
    return values.astype(np.uint64, copy=False).view(np.int64)
