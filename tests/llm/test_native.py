"""Decontamination, sharding and mixing on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from compare import compare
from pyspark.sql import functions as F

from orrery.llm import decontaminate, mixing, sharding
from orrery.llm.queries import QUERIES, SQL

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
DOCS = [
    (1, "x one two THREE four five six seven eight nine ten eleven y", "a", 0), (2, None, None, 1), (3, "", "a", 2),
    (4, "tiny Item", "b", 3), (4, "tiny Item", "b", 3), (5, "tiny, item! é tiny item", "b", 4), (None, "tiny item", "c", 5),
    (6, "none here", "a", 6), (7, "-- one", "a", 7), (8, "one two three four five six seven eight nine ten " * 3000, "a", 8),
    (4, "other text", "b", 9),
]
ITEMS = [(10, "One two three four five six seven eight nine ten eleven"), (9, "TINY item"), (8, None), (7, "..."),
         (None, "none here"), (6, "nine ten one two three four five six seven eight nine"), (5, "é")]
SCHEMA = "doc_id long, text string, source string, hits int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    found, hit, items = WORD.findall(lower(text)), set(), set()
    for item, passage in ITEMS:
        words = WORD.findall(lower(passage))
        length = min(len(words), 10)
        runs = {tuple(words[i : i + length]) for i in range(len(words) - length + 1)} if length else set()
        for i in range(len(found) - length + 1 if length else 0):
            if tuple(found[i : i + length]) in runs:
                hit |= set(range(i, i + length))
                items |= {str(item)} if item is not None else set()
    return len(found), len(hit), sorted(items), bool(hit)


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(DOCS, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("broadcast", [True, False])
def test_hits_against_plain_python(spark, tables, broadcast, monkeypatch):
    documents, items = tables
    if not broadcast:
        monkeypatch.setattr(decontaminate.find, "__defaults__", (10, "doc_id", "text", 0))
    rows = decontaminate.report(documents, items).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in rows)
    expected = Counter((d[0], *(tuple(x) if isinstance(x, list) else x for x in brute(d[1]))) for d in DOCS)
    assert got == expected


def test_removal(spark, tables):
    documents, items = tables
    left = decontaminate.remove_documents(documents, items)
    assert left.columns == documents.columns
    assert Counter(r.hits for r in left.collect()) == Counter(d[3] for d in DOCS if not brute(d[1])[3])
    cut = {r.hits: r.text for r in decontaminate.remove_spans(documents, items).collect()}
    assert cut[0] == "x y" and cut[4] == "" and cut[6] == "" and cut[7] == "-- one" and cut[9] == "other text"


def test_no_items_and_no_documents(spark, tables):
    documents, items = tables
    assert not any(r.contaminated for r in decontaminate.report(documents, items.limit(0)).collect())
    assert decontaminate.report(documents.limit(0), items).count() == 0


@pytest.mark.parametrize("name", ["op5_shard_placement", "op10_benchmark_decontamination"])
def test_queries_like_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", QUERIES[name], SQL[name]) is None


def test_lookup_table_is_even_and_stable():
    table = Counter(sharding.lookup_table())
    assert max(table.values()) - min(table.values()) <= 1 and sum(table.values()) == sharding.SLOTS
    assert sharding.moved(sharding.SHARDS, sharding.SHARDS[:-1]) < 0.2
    with pytest.raises(ValueError):
        sharding.lookup_table(slots=2048)


def test_placement_of_odd_rows(spark, tables):
    documents = tables[0].withColumn("shard", F.lit("own"))
    placed = sharding.place(documents).collect()
    assert len(placed) == len(DOCS)
    table = sharding.lookup_table()
    for row in placed:
        key = "" if row.doc_id is None else str(row.doc_id)
        assert row.slot == int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % sharding.SLOTS and row.shard == table[row.slot]
    assert sharding.place(documents.limit(0)).count() == 0
    plan = sharding.place(documents)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    assert sum(mixing.targets([5, 900, 40, 30, 7])) == pytest.approx(1.5 * 982)


def test_quotas_are_exact():
    quotas = mixing.split_quotas([1000, 0, 37, 5], 16)
    assert quotas.sum(axis=1).tolist() == [1000, 0, 37, 5] and (quotas >= 0).all()
    assert max(quotas.sum(axis=0)) - min(quotas.sum(axis=0)) <= 1
    assert mixing._draw(mixing.np.random.default_rng(1), mixing.np.array([3 * 10**9, 10**9]), 10**9).sum() == 10**9


def size(text):
    return len(re.findall("[^\\x20\\x09-\\x0D]+", text or ""))


def check_mix(rows, texts):
    """Sizes, targets and bounds of (doc_id, source) -> text against a plain computation."""
    by = defaultdict(int)
    for source, text in texts:
        by[source] += size(text)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([by[n] for n in names]), strict=True))
    got = defaultdict(int)
    for row in rows:
        assert row.source_size == by[row.source] and row.target == goal[row.source] and 0 <= row.taken <= 2 * row.size
        got[row.source] += row.taken
    for name in names:
        assert abs(got[name] - goal[name]) <= mixing.BLOCK_WORDS / 2 + 1


def test_mix_of_odd_rows(spark, tables):
    rows, draws = mixing.plan(tables[0])
    found = mixing.taken(rows, draws).collect()
    assert Counter((r.id, r.size) for r in found) == Counter((d[0], size(d[1])) for d in DOCS)
    check_mix(found, [(d[2], d[1]) for d in DOCS])
    assert mixing.taken(*mixing.plan(tables[0].limit(0))).count() == 0
    mixed = mixing.mix(tables[0])
    assert mixed.columns == tables[0].columns and max(Counter(r.hits for r in mixed.collect()).values()) <= 4
    assert mixing.mix(tables[0].limit(0)).count() == 0


def test_mixing_query(spark):
    folder = "/root/testdata/sf0.01"
    rows, draws = mixing.plan(spark.read.parquet(f"{folder}/documents.parquet"))
    texts = [(r.source, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = mixing.taken(rows, draws).collect()
    assert len(found) == len(texts)
    check_mix(found, texts)
    again = {r.doc_id: r.taken for r in QUERIES["op6_source_mixing"](spark, folder).collect()}
    assert again == {r.id: r.taken for r in found}
    shards = draws.groupBy("shard").agg(F.count("*").alias("n"), F.sum("words")).collect()
    counts = [r.n for r in shards]
    assert len(counts) == mixing.SHARDS and max(counts) - min(counts) <= 1
    assert draws.groupBy("row", "block", "pass").count().filter("count > 1").count() == 0
