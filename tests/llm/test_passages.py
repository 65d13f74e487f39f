import random
from collections import defaultdict

import pytest
from brute import words

from orrery.llm import suffixes

SCHEMA = "doc_id long, text string, key string, at int"


def brute(texts, length):
    """Maximal stretches of repeated runs, by listing every run of every text."""
    documents = {(i, t): words(t) for i, t, *_ in texts}
    seen = defaultdict(set)
    for key, found in documents.items():
        for at in range(len(found) - length + 1):
            seen[tuple(found[at : at + length])].add(key)
    result = []
    for key, found in documents.items():
        at = [i for i in range(len(found) - length + 1) if len(seen[tuple(found[i : i + length])]) > 1]
        while at:
            start = end = at.pop(0)
            while at and at[0] <= end + length:
                end = at.pop(0)
            result.append((key[0], start, end + length))
    return sorted(result, key=str)


def texts(seed):
    r = random.Random(seed)
    new = lambda n: [f"w{r.randrange(100000)}" for _ in range(n)]
    shared = [new(n) for n in (49, 50, 51, 60, 75, 140)]
    rows = []
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts += new(r.randrange(0, 70))
            passage = list(r.choice(shared))
            if r.random() < 0.4:
                passage[r.randrange(len(passage))] = "changed"
            parts += passage if r.random() < 0.8 else []
        rows.append(" ".join(parts + new(r.randrange(0, 40))))
    own = new(60)
    rows += [None, "", "x", "the " * 3000, "the " * 40, " ".join(own + new(5) + own), " ".join(new(2000)), rows[3], rows[4]]
    table = [(i, t, "own", 1) for i, t in enumerate(rows)]
    return table + table[:3] + [(None, rows[5], "own", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_against_all_runs(spark, seed):
    rows = texts(seed)
    found = suffixes.passages(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = sorted([(r.doc_id, r.start_word, r.end_word) for r in found.collect()], key=str)
    assert got == brute(rows, 50)
    assert all(r.n_words == r.end_word - r.start_word for r in found.limit(5).collect())


def test_no_rows(spark):
    assert suffixes.passages(spark.createDataFrame([], SCHEMA)).count() == 0
