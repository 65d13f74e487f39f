"""Text building, cleaning, search and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.operators import embed, items, ratings
from orrery.plans import inputs
from orrery.plans.registry import query
from orrery.plans.sql import with_views
from orrery.session import fresh_path
from orrery.sources import readers, views
from orrery.streaming import resume

_DOC_TEXT = "doc_id long, text string, lang string, source string, n_chars long"
_STRIP = r"REGEXP_REPLACE({0}, '^\s+|\s+$', '', 'g')"


@query("template_text", with_views("recipes", "recipe_tags", body="""
    , t AS (SELECT id, STRING_AGG(tag, ', ' ORDER BY tag) AS tags FROM recipe_tags GROUP BY id)
    SELECT r.id, TRIM(CONCAT(COALESCE(name, ''), '. ', COALESCE(CAST(minutes AS VARCHAR), ''), ' min. Tags: ', tags, '.')) AS text
    FROM recipes r JOIN t ON r.id = t.id"""))
def template_text(spark, folder):
    tags = views.recipe_tags(spark, folder).groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    rows = views.recipes(spark, folder).join(tags, "id")
    return rows.select("id", X.template_text(rows, "{name}. {minutes} min. Tags: {tags}.{unknown}").alias("text"))


@query("title_abstract", with_views("papers", body=f"""
    SELECT id, MD5(text) AS digest, LENGTH(text) AS n_chars FROM (
      SELECT id, CASE WHEN title <> '' THEN CONCAT(title, ' [SEP] ', a) ELSE a END AS text
      FROM (SELECT id, title, {_STRIP.format('abstract')} AS a FROM papers) WHERE a <> '')"""))
def title_abstract(spark, folder):
    rows = views.papers(spark, folder)
    joined = rows.select("id", X.title_abstract(F.col("title"), F.col("abstract")).alias("text"))
    return joined.filter(F.col("text").isNotNull()).select(
        "id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query("doi_url", with_views("papers", body="""
    SELECT id, CASE WHEN doi IS NULL OR TRIM(doi) = '' THEN CONCAT('https://arxiv.org/abs/', id)
                    WHEN STARTS_WITH(TRIM(doi), 'http') THEN TRIM(doi)
                    ELSE CONCAT('https://doi.org/', TRIM(doi)) END AS url FROM papers"""))
def doi_url(spark, folder):
    return views.papers(spark, folder).select("id", X.doi_url(F.col("doi"), F.col("id")).alias("url"))


@query("clean_text", f"""
    SELECT doc_id, MD5(REPLACE({_STRIP.format('text')}, CHR(10), ' ')) AS digest,
           CASE WHEN LENGTH(text) > 200 THEN CONCAT(SUBSTR(text, 1, 200), '...') ELSE text END AS preview FROM documents""")
def clean_text(spark, folder):
    return views.table(spark, folder, "documents").select(
        "doc_id", F.md5(X.clean_text(F.col("text"))).alias("digest"), X.truncated(F.col("text"), 200).alias("preview"))


@query("name_search", with_views("interactions", "recipes", body="""
    SELECT recipe_id, name, ROUND(AVG(rating), 2) AS avg_rating, COUNT(rating) AS num_reviews
    FROM interactions JOIN recipes ON recipe_id = id WHERE REGEXP_MATCHES(name, 'RED .*(ring|bolt)', 'i')
    GROUP BY recipe_id, name ORDER BY num_reviews DESC, recipe_id LIMIT 10"""))
def name_search(spark, folder):
    named = views.recipes(spark, folder).filter(X.name_matches(F.col("name"), "RED .*(ring|bolt)"))
    found = ratings.popularity(views.interactions(spark, folder), named).drop("rating_std")
    return ratings.top(found, "num_reviews", 10, ["recipe_id"])


@query("substr_search", with_views("recipes", body="SELECT id, name FROM recipes WHERE CONTAINS(LOWER(name), 'ring')"))
def substr_search(spark, folder):
    return views.recipes(spark, folder).select("id", "name").filter(X.name_contains(F.col("name"), "RING"))


@query("year_of", with_views("recipes", body="""
    SELECT id, CASE WHEN id % 13 <> 0 THEN CAST(SUBSTR(submitted, 1, 4) AS INT) END AS year,
           CASE WHEN id % 13 <> 0 THEN CAST(SUBSTR(submitted, 1, 4) AS DOUBLE) END AS value FROM recipes"""))
def year_of(spark, folder):
    from orrery.functions.encode import numeric_value

    raw = F.when(F.col("id") % 13 == 0, "not a date").otherwise(F.col("submitted"))
    return views.recipes(spark, folder).select(
        "id", X.year_of(raw).alias("year"), numeric_value(raw, True).alias("value"))


@query("stat_lines", with_views("records", body="""
    , r AS (SELECT *, CAST(FLOOR(avg_rating) AS BIGINT) * 10 + (CAST((avg_rating - FLOOR(avg_rating)) * 4503599627370496 AS BIGINT) * 10
                      + 2251799813685248) // 4503599627370496 AS t FROM records)
    SELECT id, CONCAT_WS(' · ', CASE WHEN avg_rating IS NOT NULL THEN CONCAT('★ ', t // 10, '.', t % 10, ' (', CAST(n_ratings AS VARCHAR), ' ratings)') END,
           CASE WHEN minutes <> 0 THEN CONCAT(CAST(minutes AS VARCHAR), ' min') END, CONCAT(CAST(n_steps AS VARCHAR), ' steps'),
           CONCAT(CAST(n_ingredients AS VARCHAR), ' ingredients'), SUBSTR(submitted, 1, 7)) AS line,
           CONCAT(REPEAT('★', n_steps % 6), REPEAT('☆', 5 - n_steps % 6)) AS stars FROM r"""))
def stat_lines(spark, folder):
    c = F.col
    return inputs.records(spark, folder).select(
        "id", X.stat_line(c("avg_rating"), c("n_ratings"), c("minutes"), c("n_steps"), c("n_ingredients"), c("submitted")).alias("line"),
        X.star_string(c("n_steps") % 6).alias("stars"))


@query("hover_text", with_views("assignments", "recipes", "recipe_items", body="""
    , l AS (SELECT id, STRING_AGG(CONCAT(family, ': ', category, ' (', PRINTF('%.2f', score), ')'), CHR(10) ORDER BY family) AS labels
            FROM assignments GROUP BY id)
    , d AS (SELECT id, ingredient, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ingredient) AS r, COUNT(*) OVER (PARTITION BY id) AS n
            FROM (SELECT DISTINCT id, ingredient FROM recipe_items))
    , i AS (SELECT id, CONCAT('Ingredients: ', STRING_AGG(ingredient, ', ' ORDER BY r), CASE WHEN n > 6 THEN CONCAT(' +', CAST(n - 6 AS VARCHAR), ' more') ELSE '' END) AS items
            FROM d WHERE r <= 6 GROUP BY id, n)
    SELECT r.id, CONCAT_WS(CHR(10), COALESCE(name, 'Unknown'), labels, CASE WHEN minutes <> 0 THEN CONCAT('Time: ', CAST(minutes AS VARCHAR), ' min') END,
           items, submitted) AS text FROM recipes r JOIN l ON l.id = r.id LEFT JOIN i ON i.id = r.id"""))
def hover_text(spark, folder):
    chosen = inputs.assignments(spark, folder)
    labels = chosen.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("family", "category", "score"))).alias("labels"))
    held = views.recipe_items(spark, folder).groupBy("id").agg(F.array_sort(F.collect_set("ingredient")).alias("items"))
    c = F.col
    shown = X.hover_text(c("name"), c("labels"), c("minutes"), c("items"), c("submitted"))
    return views.recipes(spark, folder).join(labels, "id").join(held, "id", "left").select("id", shown.alias("text"))


@query("item_preview", with_views("recipe_items", body="""
    , r AS (SELECT id, ingredient, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ingredient) AS r, COUNT(*) OVER (PARTITION BY id) AS n
            FROM (SELECT DISTINCT id, ingredient FROM recipe_items))
    SELECT id, CONCAT(STRING_AGG(ingredient, ', ' ORDER BY r), CASE WHEN n > 6 THEN CONCAT(' +', CAST(n - 6 AS VARCHAR), ' more') ELSE '' END) AS preview
    FROM r WHERE r <= 6 GROUP BY id, n"""))
def item_preview(spark, folder):
    held = items.previews(views.recipe_items(spark, folder), 6)
    more = F.when(F.col("more") > 0, F.concat(F.lit(" +"), F.col("more").cast("string"), F.lit(" more"))).otherwise("")
    return held.select("id", F.concat(F.array_join("items", ", "), more).alias("preview"))


@query("list_literal", with_views("recipes", body="""
    SELECT id, CASE WHEN id % 11 = 0 THEN 0 WHEN id % 7 = 0 THEN 3 ELSE 2 END AS n,
           CASE WHEN id % 11 = 0 THEN '' WHEN id % 7 = 0 THEN CONCAT(COALESCE(name, ''), '|it''s|b')
                ELSE CONCAT(COALESCE(name, ''), '|', submitted) END AS items FROM recipes"""))
def list_literal(spark, folder):
    name = F.coalesce("name", F.lit(""))
    literal = (
        F.when(F.col("id") % 11 == 0, "[broken")
        .when(F.col("id") % 7 == 0, F.concat(F.lit("['"), name, F.lit("', \"it's\", 'b']")))
        .otherwise(F.concat(F.lit("['"), name, F.lit("', '"), F.col("submitted"), F.lit("']"))))
    parsed = views.recipes(spark, folder).select("id", X.parse_list(literal).alias("items"))
    return parsed.select("id", F.size("items").alias("n"), F.array_join("items", "|").alias("items"))


@query("free_text", f"""
    SELECT MD5(t) AS digest, lang AS label, CAST(n_chars AS VARCHAR) AS rating FROM (SELECT {_STRIP.format('text')} AS t, lang, n_chars FROM documents)
    WHERE t <> ''""")
def free_text(spark, folder):
    rows = readers.free_text(views.table(spark, folder, "documents"), "text", "lang", "n_chars")
    return rows.select(F.md5("text").alias("digest"), "label", "rating")


@query("category_index", with_views("classes", body=r"""
    SELECT family, label, CONCAT(family, '_', LOWER(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(
             REPLACE(REPLACE(REPLACE(label, '+', 'plus'), '<', 'lt'), '>', 'gt'), '[^A-Za-z0-9.\-]', '-', 'g'),
             '-+', '-', 'g'), '^-+|-+$', '', 'g')), '.json.gz') AS file
    FROM (SELECT DISTINCT c.family, c.label FROM classes c CROSS JOIN (SELECT COUNT(*) FROM part))"""))
def category_index(spark, folder):
    from orrery.operators.categories import rollup
    from orrery.sources.writers import category_index as index

    return index(rollup(inputs.assignments(spark, folder), views.interactions(spark, folder), inputs.classes(spark)))


@query("chart_series", with_views("interactions", body="""
    , c AS (SELECT rating, COUNT(*) AS n FROM interactions GROUP BY rating)
    SELECT CONCAT('{"labels":[', STRING_AGG(CONCAT('"', CAST(rating AS VARCHAR), '"'), ',' ORDER BY rating), '],"counts":[',
                  STRING_AGG(CAST(n AS VARCHAR), ',' ORDER BY rating), '],"yMin":', CAST(MIN(n) AS VARCHAR), ',"yMax":', CAST(MAX(n) AS VARCHAR), '}') AS json
    FROM c"""))
def chart_series(spark, folder):
    from orrery.sources.writers import chart_series as series

    counts = views.interactions(spark, folder).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    return series(counts.withColumn("label", F.col("rating").cast("string")), "label", "n", "rating")


@query("embed")
def embed_documents(spark, folder):
    docs = views.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return embed.embed_text(docs)


@query("incremental_embed")
def incremental_embed(spark, folder):
    base = fresh_path(spark, "embed")

    def prepare(batch):
        return batch.select(F.col("doc_id").alias("id"), X.strip(F.col("text")).alias("text")).filter("text <> ''")

    # a pattern, for the table may be one file or a folder of files; a plain path may only be a folder here
    resume.embed_incrementally(
        spark, f"{folder}/{{documents.parquet}}", _DOC_TEXT, f"{base}/vectors", f"{base}/state", prepare)
    return resume.embedded(spark, f"{base}/vectors")
