"""Tables that go out through a sink and come back through a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.config import ENCODERS
from orrery.operators import categories, clusters, density, documents, layout, ratings, relate
from orrery.plans import inputs
from orrery.plans.registry import query
from orrery.plans.scene import _MORTON
from orrery.plans.sql import bin_sql, dense_sql, with_views
from orrery.session import fresh_path
from orrery.sources import readers, schemas, views, writers
from orrery.streaming import resume


@query("jsonl_scan", with_views("papers", body=r"""
    , l AS (SELECT id, title, abstract, doi FROM papers)
    SELECT id, title, MD5(abstract) AS digest, doi, CAST((SELECT COUNT(*) FROM nation) AS BIGINT) AS n_unreadable,
           CAST((SELECT COUNT(*) FROM region) AS BIGINT) AS n_without_id FROM l"""))
def jsonl_scan(spark, folder):
    """All documents as JSON lines, among unreadable lines (one per nation) and lines without an id (one per region)."""
    path = fresh_path(spark, "jsonl")
    good = views.papers(spark, folder).select(F.to_json(F.struct("id", "title", "abstract", "doi")).alias("value"))
    broken = views.table(spark, folder, "nation").select(F.concat(F.lit("{broken "), "n_name").alias("value"))
    nameless = views.table(spark, folder, "region").select(F.to_json(F.struct(F.col("r_name").alias("title"))).alias("value"))
    good.unionByName(broken).unionByName(nameless).write.text(path)
    rows = readers.json_lines(spark, path, schemas.PAPERS)
    counts = readers.rejects(rows).select(F.struct("*")).scalar()
    return readers.valid_records(rows).select(
        "id", "title", F.md5("abstract").alias("digest"), "doi",
        counts["n_unreadable"].alias("n_unreadable"), counts["n_without_id"].alias("n_without_id"))


@query("csv_scan", """
    SELECT user_id, recipe_id, rating, MD5(review) AS digest FROM (
      SELECT d.doc_id AS user_id, d.doc_id + 1 AS recipe_id, CAST(d.n_chars % 6 AS INT) AS rating,
             REPLACE(REPLACE(d.text, CHR(13), ' '), '\\', '/') AS review FROM documents d)""")
def csv_scan(spark, folder):
    """All documents as quoted multi-line reviews."""
    path = fresh_path(spark, "csv")
    text = F.translate(F.col("text"), "\r\\", " /")
    rows = views.table(spark, folder, "documents").select(
        F.col("doc_id").alias("user_id"), (F.col("doc_id") + 1).alias("recipe_id"), F.lit("2020-01-01").alias("date"),
        (F.col("n_chars") % 6).cast("int").alias("rating"), text.alias("review"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.interactions_csv(spark, path).select("user_id", "recipe_id", "rating", F.md5("review").alias("digest"))


@query("recipe_fallback", with_views("recipes", "recipe_tags", body="""
    SELECT r.id, name, minutes, STRING_AGG(tag, ',' ORDER BY tag) AS tags FROM recipes r JOIN recipe_tags t ON r.id = t.id
    GROUP BY ALL"""))
def recipe_fallback(spark, folder):
    """Records from CSV with list literals, because there is no JSON file."""
    path = fresh_path(spark, "recipes")
    tags = views.recipe_tags(spark, folder).groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("t"))
    literal = F.concat(F.lit("['"), F.array_join("t", "', '"), F.lit("']"))
    empty = F.lit("[]")
    views.recipes(spark, folder).join(tags, "id").select(
        "name", "id", "minutes", F.lit(None).cast("long").alias("contributor_id"), "submitted", literal.alias("tags"),
        empty.alias("nutrition"), "n_steps", empty.alias("steps"), F.lit(None).cast("string").alias("description"),
        empty.alias("ingredients"), "n_ingredients").write.option("header", True).option("escape", '"').csv(path)
    found = readers.recipes(spark, f"{path}-missing.jsonl", path)
    return found.select("id", "name", "minutes", F.array_join("tags", ",").alias("tags"))


@query("class_list", """
    SELECT 'types' AS family, CAST(ROW_NUMBER() OVER (ORDER BY t DESC) - 1 AS INT) AS idx, t AS label
    FROM (SELECT DISTINCT LOWER(p_type) AS t FROM part)""")
def class_list(spark, folder):
    """A class file keeps its order, here descending."""
    path = fresh_path(spark, "classes")
    types = views.table(spark, folder, "part").select(F.lower("p_type").alias("value")).distinct()
    types.orderBy(F.col("value").desc()).coalesce(1).write.text(path)
    return categories.class_table(spark, {"types": readers.class_list(spark, path)})


@query("vector_table", with_views("vectors", body="SELECT id, LEN(embedding) AS width, ROUND(embedding[64], 6) AS last FROM vectors"))
def vector_table(spark, folder):
    path = fresh_path(spark, "vectors")
    writers.vectors(views.embeddings(spark, folder), path)
    return spark.read.parquet(path).select(
        "id", F.size("embedding").cast("long").alias("width"), F.round(F.element_at("embedding", 64).cast("double"), 6).alias("last"))


@query("feature_registry", with_views("recipes", body="""
    SELECT family, COUNT(*) AS n, width FROM (SELECT 'n_steps' AS family, 5 AS width FROM recipes UNION ALL
      SELECT 'n_ingredients', 4 FROM recipes) GROUP BY family, width"""))
def feature_registry(spark, folder):
    """Families are found in the stored table; one without a class list (minutes) is left out."""
    path = fresh_path(spark, "features")
    chosen = [e for e in ENCODERS if e.field in ("minutes", "n_steps", "n_ingredients")]
    writers.features(categories.encode_features(views.recipes(spark, folder), chosen), path)
    classes = categories.class_table(spark, {e.field: e.classes for e in chosen if e.field != "minutes"})
    found = readers.features(spark, path, classes)
    return found.groupBy("family", F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))


@query("sharded_metrics", with_views("interactions", "recipes", body="""
    , s AS (SELECT recipe_id, COUNT(*) AS n FROM interactions GROUP BY recipe_id)
    SELECT LPAD(RIGHT(CAST(id AS VARCHAR), 2), 2, '0') AS shard, CAST(id AS VARCHAR) AS id, n AS n_reviews
    FROM recipes LEFT JOIN s ON id = recipe_id"""))
def sharded_metrics(spark, folder):
    path = fresh_path(spark, "metrics")
    writers.sharded_metrics(ratings.summary_documents(views.recipes(spark, folder), views.interactions(spark, folder)), path)
    stored = spark.read.schema("id string, metrics struct<n_reviews:bigint>, shard string").json(path)
    return stored.select("shard", "id", F.col("metrics.n_reviews").alias("n_reviews"))


@query("category_files", with_views("assignments", body="""
    SELECT family, category, COUNT(*) AS recipe_count FROM assignments GROUP BY ALL"""))
def category_files(spark, folder):
    path = fresh_path(spark, "categories")
    writers.per_category(categories.rollup(inputs.assignments(spark, folder), views.interactions(spark, folder)), path)
    stored = spark.read.schema("category string, recipe_count long, family string, slug string").json(path)
    return stored.select("family", "category", "recipe_count")


_YEARS = """
    , y AS (SELECT family, category, STRING_AGG(year || ':' || n, ',' ORDER BY year) AS years FROM (
              SELECT family, category, CAST(YEAR(date) AS INT) AS year, COUNT(*) AS n
              FROM assignments JOIN interactions ON id = recipe_id WHERE date IS NOT NULL GROUP BY ALL) GROUP BY ALL),
    r AS (SELECT family, category, COUNT(*) AS total_reviews, ROUND(AVG(CASE WHEN rating > 0 THEN rating END), 4) AS avg_rating,
                 COUNT(CASE WHEN rating = 5 THEN 1 END) AS count_5, COUNT(CASE WHEN rating = 1 THEN 1 END) AS count_1
          FROM assignments JOIN interactions ON id = recipe_id GROUP BY ALL),
    c AS (SELECT family, category, COUNT(*) AS recipe_count FROM assignments GROUP BY ALL),
    s AS (SELECT p.family, p.label AS category, STRING_AGG(q.family || '/' || q.label || ':' || COALESCE(k.n, 0), ',' ORDER BY q.family, q.label) AS spread
          FROM classes p CROSS JOIN classes q LEFT JOIN (
            SELECT a.family, a.category, b.family AS secondary, b.category AS label, COUNT(*) AS n
            FROM assignments a JOIN assignments b ON a.id = b.id GROUP BY ALL) k
            ON k.family = p.family AND k.category = p.label AND k.secondary = q.family AND k.label = q.label
          WHERE q.family IN ('n_steps', 'submitted') GROUP BY ALL)"""


@query("category_documents", with_views("interactions", "assignments", "classes", body=_YEARS + """
    SELECT p.family, p.label AS category, COALESCE(recipe_count, 0) AS recipe_count, avg_rating,
           COALESCE(total_reviews, 0) AS total_reviews, COALESCE(count_5, 0) AS count_5, COALESCE(count_1, 0) AS count_1,
           COALESCE(years, '') AS years, MD5(spread) AS spread
    FROM classes p LEFT JOIN c ON c.family = p.family AND c.category = p.label
      LEFT JOIN r ON r.family = p.family AND r.category = p.label LEFT JOIN y ON y.family = p.family AND y.category = p.label
      LEFT JOIN s ON s.family = p.family AND s.category = p.label"""))
def category_documents(spark, folder):
    """Nested category documents through their files, read back whole."""
    path = fresh_path(spark, "documents")
    rows, classes = inputs.assignments(spark, folder), inputs.classes(spark)
    made = documents.category_documents(rows, views.interactions(spark, folder), classes, ("n_steps", "submitted"))
    writers.category_documents(made, documents.category_items(rows, views.recipe_items(spark, folder)), path)
    stars = ", ".join(f"count_{i}: bigint" for i in range(1, 6))
    stored = spark.read.schema(
        f"category string, recipe_count long, reviews struct<avg_rating: double, total_reviews: bigint, {stars}, "
        "n_per_year: map<string, bigint>>, distributions map<string, map<string, bigint>>, family string, slug string"
    ).json(f"{path}/documents")

    def listed(pairs, before=F.lit("")):
        return F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(before, e["key"], F.lit(":"), e["value"].cast("string")))

    # entries of a map of maps are sorted by family, for maps do not compare
    families = F.array_sort(F.map_keys("distributions"))
    spread = F.flatten(F.transform(families, lambda f: listed(F.col("distributions")[f], F.concat(f, F.lit("/")))))
    return stored.select(
        "family", "category", "recipe_count", "reviews.avg_rating", "reviews.total_reviews", "reviews.count_5", "reviews.count_1",
        F.array_join(listed(F.col("reviews.n_per_year")), ",").alias("years"), F.md5(F.array_join(spread, ",")).alias("spread"))


@query("category_item_files", with_views("assignments", "recipe_items", body="""
    SELECT family, category, ROW_NUMBER() OVER (PARTITION BY family, category ORDER BY n DESC, ingredient) - 1 AS position, ingredient, n
    FROM (SELECT family, category, ingredient, COUNT(*) AS n FROM assignments a JOIN recipe_items i ON a.id = i.id GROUP BY ALL)"""))
def category_item_files(spark, folder):
    """The items of all categories through the same files."""
    path = fresh_path(spark, "documents")
    rows = inputs.assignments(spark, folder)
    made = documents.category_documents(rows, views.interactions(spark, folder), inputs.classes(spark), ())
    writers.category_documents(made, documents.category_items(rows, views.recipe_items(spark, folder)), path)
    return spark.read.schema("category string, position long, ingredient string, n long, family string, slug string").json(
        f"{path}/items").select("family", "category", "position", "ingredient", "n")


@query("chart_points", with_views("points", body="SELECT ROUND(x, 6) AS x, ROUND(y, 6) AS y FROM points"))
def chart_points(spark, folder):
    """All pairs of a scatter chart through their file."""
    path = fresh_path(spark, "chart")
    writers.chart_points(views.points(spark, folder), "x", "y", path)
    return spark.read.schema("x double, y double").json(path).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("chart_values", with_views("recipes", body="SELECT CAST(minutes AS DOUBLE) AS value FROM recipes WHERE minutes IS NOT NULL"))
def chart_values(spark, folder):
    """All raw values of a histogram through their file."""
    path = fresh_path(spark, "chart")
    writers.chart_values(views.recipes(spark, folder), "minutes", path)
    return spark.read.schema("value double").json(path)


@query("chunk_files", with_views("points", body=_MORTON + " SELECT id, position, position // 64 AS chunk_id FROM o"))
def chunk_files(spark, folder):
    path = fresh_path(spark, "chunks")
    writers.chunks(layout.z_ordered(views.points(spark, folder), 64), path)
    stored = spark.read.schema("id long, position long, chunk_id long").json(path)
    return stored.select("id", "position", "chunk_id")


@query("entity_documents", with_views("interactions", "recipes", body="""
    SELECT r.id, name, n_ratings, first_date, ratings FROM recipes r LEFT JOIN (
      SELECT recipe_id, COUNT(*) AS n_ratings, MIN(COALESCE(CAST(date AS VARCHAR), '')) AS first_date,
             CAST(SUM(rating) AS BIGINT) AS ratings
      FROM interactions WHERE rating BETWEEN 1 AND 5 GROUP BY recipe_id) ON recipe_id = r.id"""))
def entity_documents(spark, folder):
    path = fresh_path(spark, "documents")
    writers.entity_documents(views.recipes(spark, folder), views.interactions(spark, folder), path)
    heads = spark.read.schema("id long, name string, n_ratings long").json(f"{path}/metrics")
    lists = spark.read.schema("recipe_id long, date string, rating int, position long").json(f"{path}/ratings")
    folded = lists.groupBy(F.col("recipe_id").alias("id")).agg(
        F.max(F.when(F.col("position") == 0, F.col("date"))).alias("first_date"), F.sum("rating").alias("ratings"))
    return heads.join(folded, "id", "left").select("id", "name", "n_ratings", "first_date", "ratings")


@query("csv_sink", with_views("interactions", body="""
    SELECT recipe_id, ROUND(AVG(rating), 6) AS avg_rating, COUNT(*) AS n FROM interactions GROUP BY 1
    ORDER BY n DESC, recipe_id LIMIT 10"""))
def csv_sink(spark, folder):
    path = fresh_path(spark, "top")
    counted = views.interactions(spark, folder).groupBy("recipe_id").agg(
        F.round(F.avg("rating"), 6).alias("avg_rating"), F.count(F.lit(1)).alias("n"))
    writers.small_csv(ratings.top(counted, "n", 10, ["recipe_id"]), path)
    return readers.csv_table(spark, path, "recipe_id long, avg_rating double, n long", line_breaks=False)


@query("stored_shard_lookup", with_views("recipes", body="SELECT '42' AS shard, id, name FROM recipes WHERE id = 142"))
def stored_shard_lookup(spark, folder):
    """One record of a stored table: only its shard's folder is read."""
    from orrery.functions.text import shard_key

    path = fresh_path(spark, "shards")
    views.recipes(spark, folder).withColumn("shard", shard_key(F.col("id"))).hint(
        "rebalance", F.col("shard")).write.partitionBy("shard").parquet(path)
    stored = spark.read.schema("id long, name string, shard string").parquet(path)
    return relate.record_of_shard(stored, "42", 142).select("shard", "id", "name")


@query("key_lookup", "SELECT doc_id AS id, MD5(text) AS digest FROM documents WHERE doc_id = 142")
def key_lookup(spark, folder):
    """One document of a table stored in key order: one row group of one file is read."""
    path = fresh_path(spark, "lookup")
    writers.lookup_table(views.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), "id", path)
    return relate.record_of_table(spark.read.parquet(path), "id", 142).select("id", F.md5("text").alias("digest"))


@query("recluster", with_views("points", recursive=True, body=dense_sql("0.05", "5", 2)))
def recluster(spark, folder):
    """A stored layout is clustered again with another radius, without projecting again."""
    path = fresh_path(spark, "layout")
    views.points(spark, folder).select("id", "x", "y", "z").write.parquet(path)
    return density.dbscan(spark.read.parquet(path), 0.05, 5, 2)


@query("resumed_names", with_views("points", body="""
    SELECT cluster, CASE WHEN cluster <= 4 THEN 'earlier' ELSE CONCAT('named ', CAST(cluster AS VARCHAR)) END AS name
    FROM (SELECT DISTINCT cluster FROM points WHERE cluster <> -1)"""))
def resumed_names(spark, folder):
    """A second naming run names only what the first left out."""
    path = fresh_path(spark, "names")
    points = views.points(spark, folder).select("cluster")

    def constant(label):
        return lambda rows: rows.select("cluster").distinct().select("cluster", label.alias("name"))

    first = points.filter("cluster BETWEEN 1 AND 4")
    resume.name_incrementally(first, first, path, constant(F.lit("earlier")))
    named = constant(F.concat(F.lit("named "), F.col("cluster").cast("string")))
    return resume.name_incrementally(points, points, path, named)


@query("scalar_bins", with_views("recipes", body=f"""
    SELECT id, ROUND(({bin_sql(ENCODERS[-1], 'y')}) / 19.0, 6) AS position
    FROM (SELECT id, CAST(SUBSTR(submitted, 1, 4) AS DOUBLE) AS y FROM recipes)"""))
def scalar_bins(spark, folder):
    vectors = categories.encode_features(views.recipes(spark, folder), [ENCODERS[-1]])
    return vectors.select("id", F.round(F.element_at("vector", 1), 6).alias("position"))


@query("unnamed_clusters", with_views("points", body="SELECT DISTINCT cluster FROM points WHERE cluster > 4"))
def unnamed_clusters(spark, folder):
    points = views.points(spark, folder)
    return clusters.still_unnamed(points, points.filter("cluster BETWEEN 1 AND 4"))
