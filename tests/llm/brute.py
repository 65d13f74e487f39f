"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def words(text):
    return WORD.findall(text or "")


def measures(text):
    text = text or ""
    found = words(text)
    grams = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    hit = set()
    for i in range(len(found) - 2):
        if grams[tuple(found[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
    )


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=5):
    found = words(lowered(text))
    if not found:
        return set()
    return {tuple(found[i : i + size]) for i in range(max(len(found) - size, 0) + 1)}


def components(texts, size=5):
    """{row: smallest id reachable} of [(id, text)], by comparing all pairs."""
    sets = [shingles(text, size) for _, text in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 10 >= max(len(a), len(b)) * 8:
                if 100 * len(a & b) >= 80 * len(a | b):
                    root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(texts):
        ids = least.setdefault(find(i), [])
        if key is not None:
            ids.append(key)
    return [min(least[find(i)], default=None) if sets[i] else texts[i][0] for i in range(len(texts))], [find(i) for i in range(len(texts))]
