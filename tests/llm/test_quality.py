import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from brute import measures
from pyspark.sql import functions as F

from orrery.llm import quality
from orrery.llm.queries import QUERIES
from orrery.llm.words import blocks

SCHEMA = "doc_id long, text string, n_words string"
TEXTS = [
    (1, "a b c a b c d\n\na b\nx\na b\n \n \nx"), (2, None), (3, ""), (4, " \n\t\x0b"), (5, "é#*|<ß x \U0001f600"),
    (6, "a a a a"), (7, "word " * 70000), (8, "x"), (8, "x"), (None, "p\r\nq\r\np\r\n"), (9, "A!! B!! " * 40),
]


def test_measures_against_plain_python(spark):
    model = quality.train(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int"))
    rows = quality.score(spark.createDataFrame([(a, b, "own") for a, b in TEXTS], SCHEMA), model).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        expected = measures(row.text)
        assert tuple(row[m] for m in quality.MEASURES) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert row.base_failed == failed and row.kept == (not failed)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(empty, model).collect() == []


@pytest.mark.parametrize("size", ["sf0.01"])
def test_query_whole_table_and_held_out_accuracy(spark, size):
    folder = f"/root/testdata/{size}"
    rows = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, folder).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for key, text in texts.items():
        assert tuple(rows[key][m] for m in quality.MEASURES) == measures(text)
    known = spark.read.parquet(f"{folder}/labels.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3))
    model = quality.train(documents, known.filter(part != 0))
    judged = quality.score(documents, model).join(known.filter(part == 0), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) or r.base_failed for r in judged)
    assert right >= 0.95 * len(judged)


def test_a_worker_holds_the_arrays_of_a_small_block():
    r = random.Random(21)
    texts = pa.array([" ".join(f"w{r.randrange(5000)}" for _ in range(300)) for _ in range(2000)])
    model = quality.Logit(quality.GROUPS, np.zeros(2 << quality.BITS, dtype=np.int64), 0.0)
    tracemalloc.start()
    rows = 0
    for block in blocks(texts):
        quality.measures(block)
        rows += len(model.probability(quality.sequences(block)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 55_000_000
