import hashlib
import random

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from orrery.llm import infill
from orrery.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, n long, form string, id string, output string"


@pytest.mark.parametrize("share", [0.0005, 0.02, 0.3, 0.7, 0.999, 1.0])
def test_every_container_selects_what_a_list_would(share):
    draw = np.random.default_rng(3)
    flags = draw.random(200_000) < share
    flags[70_000:140_000] = draw.random() < 0.5  # a span without any or without a gap
    places, held = np.flatnonzero(flags), infill.Boundaries(flags)
    assert len(held) == len(places)
    for k in {0, len(places) - 1, *draw.integers(0, len(places), 300).tolist()}:
        assert held.select(k) == places[k]


def test_all_kinds_of_containers_are_used():
    flags = np.zeros(4 * infill.SPAN, dtype=bool)
    flags[5 : infill.SPAN : 1000] = True
    flags[infill.SPAN : 2 * infill.SPAN : 2] = True
    flags[2 * infill.SPAN : 3 * infill.SPAN - 9] = True
    held = infill.Boundaries(flags)
    assert [type(c).__name__ for c in held.containers] == ["ArrayContainer", "BitmapContainer", "RunContainer"]
    assert len(infill.Boundaries(np.zeros(0, dtype=bool))) == 0


def rows():
    r = random.Random(5)
    letters = "aé漢😀 \n<>PSM"
    texts = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 7, 40, 300]))) for _ in range(150)]
    texts += [None, "", "x", "keeps <P> in it", "<S>", "a<M>", "<", "<P", "é" * 70_000, "a" * 140_000, "aé漢😀" * 40_000]
    table = [(i, t, 1, "c", "c", "c") for i, t in enumerate(texts)]
    return table + table[:3] + [(None, "text without an id", 1, "c", "c", "c"), (-7, "negative", 1, "c", "c", "c")]


def expected(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = text[:low], text[low:high], text[high:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"
    return key, n, form, low, high - low, output, text


def test_against_plain_python(spark):
    table = rows()
    cut = infill.transform(spark.createDataFrame(table, SCHEMA).repartition(3))
    assert cut.columns == ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]
    found = cut.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(map(tuple, found), key=key) == sorted((expected(r[0], r[1]) for r in table), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["word", "line"])
def test_cuts_at_words_and_lines(spark, unit):
    texts = [(i, "\n".join(f" w{j}  x{j}" for j in range(i % 9)), 1, "", "", "") for i in range(120)]
    cut = infill.transform(spark.createDataFrame(texts, SCHEMA), unit=unit, plain_from=100, spm_below=50)
    for row in cut.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect():
        text = texts[row.doc_id][1]
        assert row.back == text and row.n == (len(text.split()) if unit == "word" else len(text.splitlines()))
        if row.form != "plain":
            middle = row.output.split("<M>")[1]
            assert len(middle.split() if unit == "word" else middle.splitlines()) == row.middle_units or row.prefix_units == 0


def test_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_like_sql(spark):
    name = "op12_fill_in_middle"
    assert compare(spark, "/root/testdata/sf0.01", QUERIES[name], SQL[name]) is None
