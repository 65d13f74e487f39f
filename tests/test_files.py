"""Round trips through files, and runs that resume."""

import csv
import gzip
import io
import json
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orrery.config import ENCODERS
from orrery.operators import categories, clusters, embed, explore, layout, ratings, relate
from orrery.sources import readers, schemas, views, writers
from orrery.streaming import resume


@pytest.fixture
def out():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_json_lines_count_rejects(spark, out):
    path = Path(out) / "papers.jsonl"
    path.write_text('{"id": "1", "title": "a"}\n\n{broken\n{"title": "no id"}\n{"id": "2", "doi": null}\n')
    rows = readers.json_lines(spark, str(path), schemas.PAPERS).cache()
    assert {r["id"] for r in readers.valid_records(rows).collect()} == {"1", "2"}
    assert tuple(readers.rejects(rows).first()) == (1, 1)
    with pytest.raises(Exception):
        readers.json_lines(spark, str(path), schemas.PAPERS, strict=True).collect()


def test_csv_with_line_breaks_in_quotes(spark, out):
    path = Path(out) / "interactions.csv"
    path.write_text('user_id,recipe_id,date,rating,review\n1,2,2020-01-02,5,"two\nlines, ""quoted"""\n1,3,never,0,\n')
    rows = readers.interactions_csv(spark, str(path)).orderBy("recipe_id").collect()
    assert rows[0]["review"] == 'two\nlines, "quoted"' and str(rows[0]["date"]) == "2020-01-02"
    assert rows[1]["date"] is None and rows[1]["rating"] == 0
    pruned = readers.csv_table(spark, str(path), schemas.INTERACTIONS, ["recipe_id", "rating"])
    assert pruned.columns == ["recipe_id", "rating"]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_csv_file_is_read_by_many_tasks(spark, out, ending):
    source = random.Random(4)
    pieces = ["word", ",", '"', "\n", " ", "é", "1", '""', "\n\n", "'", "long " * 30]
    rows = [[str(i), str(source.randrange(100)), source.choice(["2020-01-02", "no date", ""]), str(i % 6),
             "".join(source.choice(pieces) for _ in range(source.choice([1, 3, 12])))] for i in range(300)]
    for name in ("a.csv", "b.csv"):
        text = io.StringIO()
        writer = csv.writer(text, lineterminator=ending)
        writer.writerow("user_id recipe_id date rating review".split())
        writer.writerows(rows)
        (Path(out) / name).write_bytes(text.getvalue().encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(out).rdd.getNumPartitions() > 20
        table = readers.csv_table(spark, out, schemas.INTERACTIONS)
        assert "multiLine" not in table._jdf.queryExecution().toString()
        found = sorted((r["user_id"], r["recipe_id"], r["rating"], r["review"]) for r in table.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = sorted((int(r[0]), int(r[1]), int(r[3]), r[4]) for r in rows * 2)
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    # white space around a value in quotes stays as it is
    assert [f[3] for f in found] == [e[3] for e in expected]


def test_csv_header_and_odd_records(spark, out):
    path = Path(out) / "rows.csv"
    path.write_text('\ufeffA,b\n1,""\n\n2,\n3\n"x",y\n4,"open\nto the end\n')
    found = sorted(map(tuple, readers.csv_table(spark, str(path), "a int, b string").collect()), key=str)
    assert found == [(1, None), (2, None), (3, None), (4, "open\nto the end"), (None, "y")]
    with pytest.raises(Exception, match="header"):
        readers.csv_table(spark, str(path), "a int, c string").collect()
    (Path(out) / "none.csv").write_text("a,b\n")
    assert readers.csv_table(spark, f"{out}/none.csv", "a int, b string").count() == 0


def test_records_fall_back_to_csv(spark, out):
    path = Path(out) / "recipes.csv"
    path.write_text(
        "name,id,minutes,contributor_id,submitted,tags,nutrition,n_steps,steps,description,ingredients,n_ingredients\n"
        "soup,7,30,1,2005-04-12,\"['a', 'b']\",\"[1.5, 2.0]\",2,\"['x']\",good,\"['salt', \"\"cook's oil\"\"]\",2\n")
    row = readers.recipes(spark, f"{out}/missing.jsonl", str(path)).first()
    assert row["tags"] == ["a", "b"] and row["nutrition"] == [1.5, 2.0] and row["ingredients"] == ["salt", "cook's oil"]
    lines = Path(out) / "recipes.jsonl"
    lines.write_text('{"id": 8, "name": "stew", "tags": ["c"]}\n')
    assert readers.recipes(spark, str(lines), str(path)).first()["name"] == "stew"
    with pytest.raises(FileNotFoundError):
        readers.recipes(spark, None, f"{out}/nothing.csv")


def test_class_list_keeps_order(spark, out):
    path = Path(out) / "classes.txt"
    path.write_text("b\n\n  a  \nc\n")
    assert readers.class_list(spark, str(path)) == ["b", "a", "c"]


def test_free_text(spark):
    rows = spark.createDataFrame([(" a ", "x"), ("  ", "y"), (None, "z"), ("b", None)], "t string, l string")
    assert [tuple(r) for r in readers.free_text(rows, "t", "l").collect()] == [("a", "x"), ("b", None)]
    assert readers.free_text(rows, "t", max_rows=1).count() == 1


def test_vectors_and_features(spark, folder, out):
    vectors = views.embeddings(spark, folder)
    writers.vectors(vectors, f"{out}/vectors")
    assert spark.read.parquet(f"{out}/vectors").count() == vectors.count()
    features = categories.encode_features(views.recipes(spark, folder), [e for e in ENCODERS if "rating" not in e.field])
    writers.features(features, f"{out}/features")
    listed = categories.class_table(spark, {"minutes": ("a",), "n_steps": ("b",)})
    found = readers.features(spark, f"{out}/features", listed)
    assert {r["family"] for r in found.select("family").distinct().collect()} == {"minutes", "n_steps"}


def test_sharded_metrics(spark, folder, out):
    documents = ratings.summary_documents(views.recipes(spark, folder), views.interactions(spark, folder))
    writers.sharded_metrics(documents, f"{out}/metrics")
    lines = {}
    for file in Path(out).glob("metrics/shard=*/*.gz"):
        for line in gzip.open(file, "rt"):
            record = json.loads(line)
            assert file.parent.name == f"shard={record['id'].zfill(2)[-2:]}"
            lines[record["id"]] = record["metrics"]
    expected = {str(r["id"]): r for r in documents.collect()}
    assert set(lines) == set(expected)
    for key, metrics in lines.items():
        assert (metrics == {}) == expected[key]["empty"]
        if metrics:
            assert metrics["n_reviews"] == expected[key]["n_reviews"]


def test_lookup_reads_one_shard(spark, folder, out):
    from orrery.functions.text import shard_key
    from orrery.operators.relate import record_of_shard

    views.recipes(spark, folder).withColumn("shard", shard_key(F.col("id"))).write.partitionBy("shard").parquet(f"{out}/r")
    stored = spark.read.schema("id long, name string, shard string").parquet(f"{out}/r")
    found = record_of_shard(stored, "42", 142)
    assert found.count() == 1
    assert "PartitionFilters: [isnotnull(shard" in found._jdf.queryExecution().toString()


def test_category_files_and_index(spark, folder, out):
    records = views.recipes(spark, folder).join(ratings.contrib(views.interactions(spark, folder)), "id", "left")
    rolled = categories.rollup(categories.assign_bins(records, ENCODERS), views.interactions(spark, folder))
    index = writers.per_category(rolled, f"{out}/categories").collect()
    assert ("minutes", "4+ hours", "minutes_4plus-hours.json.gz") in {tuple(r) for r in index}
    stored = spark.read.json(f"{out}/categories")
    assert stored.count() == rolled.count() == len(index)


def test_chunk_files(spark, folder, out):
    placed = layout.z_ordered(views.points(spark, folder), 100)
    writers.chunks(placed, f"{out}/chunks")
    stored = spark.read.json(f"{out}/chunks")
    assert stored.filter("chunk_id = 1").agg(F.min("position"), F.max("position")).first() == (100, 199)


def test_entity_documents(spark, folder, out):
    writers.entity_documents(views.recipes(spark, folder), views.interactions(spark, folder), f"{out}/documents")
    heads = spark.read.json(f"{out}/documents/metrics")
    lists = spark.read.json(f"{out}/documents/ratings")
    assert heads.count() == views.recipes(spark, folder).count()
    total = heads.agg(F.sum("n_ratings")).first()[0]
    assert lists.count() == total


def test_small_csv(spark, out):
    writers.small_csv(spark.createDataFrame([(1, "a")], "id long, name string"), f"{out}/csv")
    assert [Path(f).read_text() for f in Path(out).glob("csv/*.csv")] == ["id,name\n1,a\n"]


def test_chart_series(spark):
    frame = spark.createDataFrame([("b", 2, 1), ("a", 5, 0)], "label string, n int, o int")
    body = json.loads(writers.chart_series(frame, "label", "n", "o").first()["json"])
    assert body == {"labels": ["a", "b"], "counts": [5, 2], "yMin": 2, "yMax": 5}


def test_stored_layout_is_clustered_again(spark, folder, out):
    from orrery.operators.density import dbscan

    views.points(spark, folder).select("id", "x", "y", "z").write.parquet(f"{out}/layout")
    cached = spark.read.parquet(f"{out}/layout")
    wide, narrow = dbscan(cached, 0.3, 5), dbscan(cached, 0.01, 5)
    assert wide.filter("cluster >= 0").count() > narrow.filter("cluster >= 0").count()


def test_embedding_resumes(spark, out):
    source = f"{out}/source"
    texts = lambda ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    prepare = lambda batch: batch.select(F.col("doc_id").alias("id"), "text")
    texts(range(5)).write.parquet(source)

    def run():
        resume.embed_incrementally(spark, source, "doc_id long, text string", f"{out}/v", f"{out}/state", prepare)
        return resume.embedded(spark, f"{out}/v")

    assert run().count() == 5
    batches = {p.name for p in Path(f"{out}/v").iterdir()}
    assert run().count() == 5 and {p.name for p in Path(f"{out}/v").iterdir()} == batches
    texts(range(4, 9)).write.mode("append").parquet(source)
    assert sorted(r["id"] for r in run().collect()) == list(range(9))
    whole = {r["id"]: r["embedding"] for r in embed.embed_text(prepare(texts(range(9)))).collect()}
    assert {r["id"]: r["embedding"] for r in run().collect()} == whole


@pytest.mark.parametrize("files", [1, 3])
def test_embedding_reads_a_table_of_one_file_or_several(spark, out, files):
    from orrery.plans.texts import incremental_embed

    rows = [(i, f"text {i}", "en", "web", 6) for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(files).write.parquet(f"{out}/parts")
    parts = sorted(Path(f"{out}/parts").glob("part-*"))
    if files == 1:
        Path(f"{out}/documents.parquet").write_bytes(parts[0].read_bytes())
    else:
        Path(f"{out}/documents.parquet").mkdir()
        for part in parts:
            Path(f"{out}/documents.parquet/{part.name}").write_bytes(part.read_bytes())
    assert sorted(r["id"] for r in incremental_embed(spark, out).collect()) == list(range(9))


def test_naming_resumes(spark, out):
    points = spark.createDataFrame([(0, "red ring"), (1, "blue pan"), (-1, "x")], "cluster int, text string")
    named = []

    def name(texts):
        named.append({r["cluster"] for r in texts.collect()})
        return clusters.distinctive_terms(texts, 1)

    spark.createDataFrame([(0, "kept")], "cluster int, name string").write.parquet(f"{out}/names")
    found = {tuple(r) for r in resume.name_incrementally(points, points, f"{out}/names", name).collect()}
    assert named == [{1}] and (0, "kept") in found and len(found) == 2


def test_first_rows(spark):
    assert [r["id"] for r in explore.first_rows(spark.range(100).repartition(5), "id", 3).collect()] == [0, 1, 2]


def test_json_lines_keep_records_with_a_mistyped_field(spark, out):
    path = Path(out) / "typed.jsonl"
    lines = ['{"id": 1, "minutes": "5", "tags": ["a"]}', '{"id": "2", "minutes": 5.0, "tags": "none"}',
             '{"id": 3, "minutes": "soon", "tags": ["b", 1]}', '{"id": 4, "minutes": {"a": 1}}', "{no json", ""]
    path.write_text("\n".join(lines))
    rows = readers.json_lines(spark, str(path), "id long, minutes int, tags array<string>")
    found = {r["id"]: (r["minutes"], r["tags"]) for r in readers.valid_records(rows).collect()}
    assert found == {1: (5, ["a"]), 2: (5, None), 3: (None, ["b", "1"]), 4: (None, None)}
    assert readers.rejects(rows).first()["n_unreadable"] == 1


def test_a_lookup_reads_one_row_group(spark, out):
    rows = spark.range(40_000).select((F.col("id") * 2).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    writers.lookup_table(rows.repartition(5), "id", f"{out}/lookup", group_bytes=64 * 1024)
    stored = spark.read.parquet(f"{out}/lookup")

    def looked_up(value):
        found = relate.record_of_table(stored, "id", value)
        plan = found._jdf.queryExecution().executedPlan()
        rows = found.collect()
        leaf = plan.collectLeaves().head()
        return rows, leaf.metrics().apply("numOutputRows").value()

    found, read = looked_up(31_414)
    assert [r["id"] for r in found] == [31_414] and 0 < read < 8_000
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,31414)]" in relate.record_of_table(stored, "id", 31_414)._jdf.queryExecution().toString()
    found, read = looked_up(31_415)
    assert found == [] and read < 8_000
