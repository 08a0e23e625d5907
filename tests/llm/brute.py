"""Plain versions of the definitions, for small tables."""

from __future__ import annotations

import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    found = words(text)
    if len(found) >= 5:
        return {tuple(found[at : at + 5]) for at in range(len(found) - 4)}
    return {tuple(found)} if found else set()


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)


def jaccard_components(rows, percent=75):
    union, sets = Union(), [(doc_id, shingles(text)) for doc_id, text in rows]
    for at, (x, one) in enumerate(sets):
        union.find(x)
        for y, other in sets[:at]:
            both = len(one & other)
            if both and 100 * both >= percent * len(one | other):
                union.join(x, y)
    return [(x, len(one), union.find(x)) for x, one in sets]
