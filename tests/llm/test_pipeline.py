from collections import Counter, defaultdict

import numpy as np
from brute import components, shingles
from pyspark.sql import functions as F
from test_native import WORD, lower, size

import corpus_pipeline
from orrery.llm import decontaminate, mixing, quality, sharding


def leaks(text, items):
    found = WORD.findall(lower(text))
    for passage in items:
        words = WORD.findall(lower(passage))
        length = min(len(words), 10)
        runs = {tuple(words[i : i + length]) for i in range(len(words) - length + 1)} if length else set()
        if length and any(tuple(found[i : i + length]) in runs for i in range(len(found) - length + 1)):
            return True
    return False


def test_stages_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    judged = {r.doc_id: r.kept for r in quality.score(docs, model).collect()}
    rows = {r.doc_id: r for r in docs.collect() if judged[r.doc_id]}
    ids = sorted(rows)
    least, _ = components([(i, rows[i].text) for i in ids])
    rows = {i: rows[i] for i, c in zip(ids, least, strict=True) if i == c or not shingles(rows[i].text)}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = {i: r for i, r in rows.items() if not leaks(r.text, items)}
    assert rows

    result = corpus_pipeline.run(spark, folder)
    assert result.columns == [*columns, "slot", "shard"]
    got = result.collect()
    times = Counter(r.doc_id for r in got)
    table = sharding.lookup_table()
    for row in got:
        assert row.doc_id in rows and row.text == rows[row.doc_id].text and row.shard == table[row.slot]
    by, words = defaultdict(int), defaultdict(int)
    for row in rows.values():
        by[row.source] += size(row.text)
        words[row.source] += times[row.doc_id] * size(row.text)
    names = sorted(by)
    largest = max(size(r.text) for r in rows.values())
    for name, goal in zip(names, mixing.targets([by[n] for n in names]), strict=True):
        assert abs(words[name] - goal) <= largest / 2 + 1
    assert max(times.values()) <= 2


def test_empty_documents(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


CLASHES = ["_own", "_key", "_kept", "_empty", "_turn", "_id", "_shard", "_place", "_hits", "_list", "_hit_id", "id", "n", "slot", "words"]


def test_extra_columns_of_any_name_go_through(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in CLASHES:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    nulls = docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    docs = docs.unionByName(docs.limit(3)).unionByName(nulls)
    before = {r.doc_id: r for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        rows = docs.collect()
        assert rows, name
        for row in rows:
            for column in set(before[row.doc_id].asDict()) - ({"slot"} if name == "sharding" else set()):
                assert row[column] == before[row.doc_id][column], (name, column)


def test_spans_are_cut_beside_columns_of_any_name(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven", "a", "b"), (2, "nothing of it", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hits string, _list string")
    items = spark.createDataFrame([(7, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    found = sorted(map(tuple, decontaminate.remove_spans(docs, items).collect()))
    assert found == [(1, "one", "a", "b"), (2, "nothing of it", "c", "d")]


def test_large_draws_follow_the_distribution():
    random = np.random.default_rng(5)
    for own, others, n in ((40, 60, 30), (3, 500, 200), (700, 5, 300), (9, 9, 18), (0, 10, 4), (10, 0, 4)):
        drawn = np.array([mixing.draw_large(random, own, others, n) for _ in range(3000)])
        whole = own + others
        mean = n * own / whole
        variance = mean * (others / whole) * (whole - n) / max(whole - 1, 1)
        assert drawn.min() >= max(0, n - others) and drawn.max() <= min(own, n)
        assert abs(drawn.mean() - mean) < 5 * (variance / 3000) ** 0.5 + 1e-9
        assert abs(drawn.var() - variance) < 0.15 * variance + 1e-9
    own, others, n = 3 * 10**11, 10**12, 7 * 10**11
    mean = n * own / (own + others)
    spread = (mean * (others / (own + others)) * (own + others - n) / (own + others)) ** 0.5
    drawn = [(mixing.draw_large(random, own, others, n) - mean) / spread for _ in range(60)]
    assert abs(np.mean(drawn)) < 0.6 and 0.6 < np.std(drawn) < 1.4
    quotas = mixing.split_quotas([4 * 10**9, 10**9, 17], 8)
    assert quotas.sum(axis=1).tolist() == [4 * 10**9, 10**9, 17] and np.ptp(quotas.sum(axis=0)) <= 1
