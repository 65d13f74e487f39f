import random
from collections import Counter

import pytest
from brute import components, shingles
from compare import compare

from orrery.llm import jaccard
from orrery.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, n_shingles string, component string"


def texts(seed, crowd=30):
    """Crowds of near copies at every distance, a passage in many texts, copies, short and odd texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [r.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(4):
        base = [r.choice(vocabulary) for _ in range(r.choice([12, 60, 150]))]
        for _ in range(crowd):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy))
    for _ in range(25):
        rows.append(" ".join(common + [r.choice(vocabulary) for _ in range(r.choice([2, 4, 6, 20, 80]))]))
    rows += ["One two", "one  TWO", "one two three", "a b c d e", "A B C D E", "", " \n", None, None, "é É", "É É", "x " * 5000, "x " * 900]
    r.shuffle(rows)
    table = [(i, t, "own", "c") for i, t in enumerate(rows)]
    return table + table[:5] + [(None, rows[7], "own", "c"), (None, "lonely text without an id", "own", "c"), (3, "another text of three", "own", "c")]


@pytest.mark.parametrize("seed, crowd, block_rows", [(1, 30, 512), (2, 30, 5), (4, 90, 16)])
def test_classes_against_all_pairs(spark, seed, crowd, block_rows):
    rows = texts(seed, crowd)
    found = jaccard.classes(spark.createDataFrame(rows, SCHEMA).repartition(5), cell_bits=12, block_rows=block_rows).collect()
    expected, _ = components([(r[0], r[1]) for r in rows])
    want = Counter((r[0], len(shingles(r[1])), c) for r, c in zip(rows, expected, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want


def test_one_row_of_each_class_stays(spark):
    rows = texts(3)
    kept = jaccard.keep_first(spark.createDataFrame(rows, SCHEMA), cell_bits=12)
    assert kept.columns == ["doc_id", "text", "n_shingles", "component"]
    _, group = components([(r[0], r[1]) for r in rows])
    full = {g for g, r in zip(group, rows, strict=True) if shingles(r[1])}
    blank = [r for r in rows if not shingles(r[1])]
    got = kept.collect()
    assert len(got) == len(full) + len(blank)
    place = {(r[0], r[1]): g for r, g in zip(rows, group, strict=True)}
    assert {place[r.doc_id, r.text] for r in got if shingles(r.text)} == full


def test_empty_table(spark):
    assert jaccard.classes(spark.createDataFrame([], SCHEMA), cell_bits=8).count() == 0
    assert jaccard.keep_first(spark.createDataFrame([], SCHEMA), cell_bits=8).count() == 0


def test_query_like_sql(spark):
    name = "op3_ngram_jaccard_join"
    assert compare(spark, "/root/testdata/sf0.01", QUERIES[name], SQL[name]) is None
