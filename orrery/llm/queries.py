"""One query per operator with production parameters over whole tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import (
    chaining, decontaminate, infill, jaccard, minhash, mixing, quality, sharding, suffixes, token_counts, url_filter, warc,
    whitening)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, folder, "labels"))
    return quality.score(documents, model).select(
        "doc_id", *quality.MEASURES, "base_failed", "kept", "quality_probability")


@query("op6_source_mixing")
def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows, draws = mixing.plan(table(spark, folder, "documents"))
    return mixing.taken(rows, draws).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


_SHARDS_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS name FROM range({len(sharding.SHARDS)}) r(i)
), lists AS (
  SELECT list(CAST('0x' || substr(md5(name || '/offset'), 1, 8) AS BIGINT) % {sharding.SLOTS} ORDER BY i) AS offsets,
         list(CAST('0x' || substr(md5(name || '/skip'), 1, 8) AS BIGINT) % {sharding.SLOTS - 1} + 1 ORDER BY i) AS skips,
         list(name ORDER BY i) AS names FROM shards
), fill AS (
  SELECT 0 AS turn, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT turn + 1, list_append(taken, (SELECT (offsets[turn % {len(sharding.SHARDS)} + 1] + j * skips[turn % {len(sharding.SHARDS)} + 1]) % {sharding.SLOTS}
     FROM lists, range({sharding.SLOTS}) r(j)
     WHERE NOT list_contains(taken, (offsets[turn % {len(sharding.SHARDS)} + 1] + j * skips[turn % {len(sharding.SHARDS)} + 1]) % {sharding.SLOTS})
     ORDER BY j LIMIT 1))
  FROM fill WHERE turn < {sharding.SLOTS}
), slots AS (
  SELECT taken[turn + 1] AS slot, names[turn % {len(sharding.SHARDS)} + 1] AS shard
  FROM (SELECT taken FROM fill WHERE turn = {sharding.SLOTS}), lists, range({sharding.SLOTS}) r(turn)
), placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.SLOTS} AS INT) AS slot
  FROM documents
)
SELECT doc_id, slot, shard FROM placed JOIN slots USING (slot)
"""


@query("op5_shard_placement", _SHARDS_SQL)
def op5_shard_placement(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents")).select("doc_id", "slot", "shard")


_WORDS_SQL = "coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
_LEAKS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT l FROM windows),
runs AS (
  SELECT r, l, s, array_to_string(w[s:s + l - 1], ' ') AS t
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lengths WHERE len(w) >= l)
),
hits AS (SELECT DISTINCT r, runs.l, s, item_id FROM runs JOIN windows USING (l, t)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""


@query("op10_benchmark_decontamination", _LEAKS_SQL)
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_SETS_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""


@query("op3_ngram_jaccard_join", _SETS_SQL)
def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document and of each of its lines."""
    return token_counts.count_lines(table(spark, folder, "documents"))


@query("op4_warc_archives")
def op4_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, folder, "pages")))
    return warc.histories(records).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "date", "verified")


#: fixed values: the rules of the query
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


@query("op7_url_filters")
def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled(spark))
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES, model)


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.passages(table(spark, folder, "documents"))


@query("op9_substring_chaining")
def op9_substring_chaining(spark: SparkSession, folder: str) -> DataFrame:
    return chaining.passages(table(spark, folder, "documents"))


_INFILL_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT *, least(CAST('0x' || h[1:8] AS BIGINT) % (n + 1), CAST('0x' || h[9:16] AS BIGINT) % (n + 1)) AS low,
         greatest(CAST('0x' || h[1:8] AS BIGINT) % (n + 1), CAST('0x' || h[9:16] AS BIGINT) % (n + 1)) AS high,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, substr(t, 1, low) AS a, substr(t, low + 1, high - low) AS b, substr(t, high + 1) AS z FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b
                        WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || b ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query("op12_fill_in_middle", _INFILL_SQL)
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = infill.transform(table(spark, folder, "documents"))
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


_NEAR_SQL = _SETS_SQL.replace("w[i:i + 4]", "w[i:i + 1]").replace("greatest(len(w) - 4, 1)", "greatest(len(w) - 1, 1)").replace(
    "AS component_id\n", "AS component_id, doc_id = (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS kept\n")


@query("op11_minhash_near_dedup", _NEAR_SQL)
def op11_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.classes(table(spark, folder, "documents"))
