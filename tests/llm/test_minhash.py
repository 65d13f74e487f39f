import random
from collections import Counter

import numpy as np
import pytest
from brute import components, shingles
from compare import compare

from orrery.llm import minhash
from orrery.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, n long, node string, keys string, component string"


def texts(seed, crowd=40):
    """Crowds of near copies at every distance, a passage in many texts, copies, short and odd texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [r.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(4):
        base = [r.choice(vocabulary) for _ in range(r.choice([30, 60, 150]))]
        for _ in range(crowd):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy))
    for _ in range(25):
        rows.append(" ".join(common + [r.choice(vocabulary) for _ in range(r.choice([2, 4, 6, 20, 80]))]))
    rows += ["One two", "one  TWO", "one two three", "one", "ONE ", "", " \n", None, None, "é É", "É É", "x " * 5000, "x " * 900]
    r.shuffle(rows)
    table = [(i, t, 1, "c", "c", "c") for i, t in enumerate(rows)]
    return table + table[:5] + [(None, rows[7], 1, "c", "c", "c"), (None, "no id here", 1, "c", "c", "c"), (3, "another three", 1, "c", "c", "c")]


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_classes_against_all_pairs(spark, block_rows):
    rows = texts(block_rows)
    found = minhash.classes(spark.createDataFrame(rows, SCHEMA).repartition(5), block_rows=block_rows)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    expected, _ = components([(r[0], r[1]) for r in rows], 2)
    want = Counter((r[0], len(shingles(r[1], 2)), c, r[0] == c) for r, c in zip(rows, expected, strict=True))
    assert Counter(map(tuple, found.collect())) == want


def test_chance_of_a_miss_is_as_stated():
    """Pairs at a similarity of 0.8 agree in two collections about as often as the formula says."""
    draw = np.random.default_rng(1)
    each, collections, missed, trials = 3, 6, 0, 4000
    for _ in range(trials):
        common = draw.integers(0, 2**63, 80, dtype=np.uint64)
        x, y = (np.concatenate([common, draw.integers(0, 2**63, 10, dtype=np.uint64)]) for _ in range(2))
        keys = minhash.collection_keys(np.concatenate([x, y]), np.array([0, 90]), each, collections)
        missed += np.count_nonzero(keys[0] == keys[1]) < 2
    p = 0.8**each
    stated = (1 - p) ** collections + collections * p * (1 - p) ** (collections - 1)
    assert abs(missed / trials - stated) < 0.02


def test_parities_never_exclude_a_link():
    draw = np.random.default_rng(2)
    for size in (20, 400, 9000):
        x = draw.integers(0, 2**63, size, dtype=np.uint64)
        y = np.concatenate([x[size // 9 :], draw.integers(0, 2**63, size // 9, dtype=np.uint64)])
        bits = minhash.parities([x, y])
        apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert apart <= len(np.setxor1d(x, y))


def test_pairs_of_the_rest_are_complete():
    """Every pair of a block that the rules name comes out, whatever the order of the rows."""
    draw = np.random.default_rng(4)
    rows = 60
    keys = draw.integers(0, 3, (rows, 5)).astype(np.uint64)
    n = draw.integers(8, 14, rows)
    classes = draw.integers(0, 20, rows)
    bits = np.packbits(draw.integers(0, 2, (rows, 64)) & (draw.random((rows, 64)) < 0.05), axis=1)
    part = draw.integers(0, 2, rows)
    for at in range(5):
        for across in (False, True):
            want = set()
            for i in range(rows):
                for j in range(i):
                    same = np.flatnonzero(keys[i] == keys[j])
                    apart = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
                    if (classes[i] != classes[j] and len(same) > 1 and same[0] == at and 9 * apart <= n[i] + n[j]
                            and 4 * max(n[i], n[j]) <= 5 * min(n[i], n[j]) and (not across or part[i] != part[j])):
                        want.add((j, i))
            i, j = minhash._possible(keys, n, classes, bits, part, at, across)
            assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want


def test_empty_table(spark):
    assert minhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, 1, "", "", ""), (2, " ", 1, "", "", "")], SCHEMA)
    assert sorted(map(tuple, minhash.classes(blank).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_query_like_sql(spark):
    name = "op11_minhash_near_dedup"
    assert compare(spark, "/root/testdata/sf0.01", QUERIES[name], SQL[name]) is None
