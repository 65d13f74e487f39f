"""Coordinates, Z-order, chunks and the exploration table."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.config import ENCODERS, PROJECTION_WEIGHTS, RangeEncoder
from orrery.functions import vectors as V
from orrery.operators import categories, explore, layout, relate
from orrery.plans import inputs
from orrery.plans.registry import query
from orrery.plans.sql import with_views
from orrery.sources import views

CHUNK = 64
_FAMILIES = tuple(encoder.field for encoder in ENCODERS)

_B = """, b AS (SELECT MIN(x) AS lx, MAX(x) AS hx, AVG(x) AS mx, MIN(y) AS ly, MAX(y) AS hy, AVG(y) AS my,
                    MIN(z) AS lz, MAX(z) AS hz, AVG(z) AS mz, GREATEST(MAX(x) - MIN(x), MAX(y) - MIN(y), MAX(z) - MIN(z)) AS span
             FROM points)"""


def _spread_sql(value: str) -> str:
    return " + ".join(
        f"CAST(({value} // {2**bit}) % 2 AS HUGEINT) * {2**(3 * bit)}" for bit in range(21)
    )


_MORTON = _B + """
    , g AS (SELECT id, CAST(FLOOR((x - lx) / GREATEST(hx - lx, 1e-9) * 2097151) AS BIGINT) AS gx,
                   CAST(FLOOR((y - ly) / GREATEST(hy - ly, 1e-9) * 2097151) AS BIGINT) AS gy,
                   CAST(FLOOR((z - lz) / GREATEST(hz - lz, 1e-9) * 2097151) AS BIGINT) AS gz FROM points, b),
    m AS (SELECT id, CAST((""" + _spread_sql("gx") + ") + 2 * (" + _spread_sql("gy") + ") + 4 * (" + _spread_sql("gz") + """) AS BIGINT) AS morton FROM g),
    o AS (SELECT id, morton, ROW_NUMBER() OVER (ORDER BY morton, id) - 1 AS position FROM m)"""


@query("morton", with_views("points", body=_MORTON + " SELECT id, morton FROM m"))
def morton(spark, folder):
    return layout.with_morton(views.points(spark, folder)).select("id", "morton")


@query("zorder_chunks", with_views("points", body=_MORTON + f" SELECT id, position, position // {CHUNK} AS chunk_id FROM o"))
def zorder_chunks(spark, folder):
    return layout.z_ordered(views.points(spark, folder), CHUNK).select("id", "position", "chunk_id")


@query("bounds", with_views("points", body="SELECT COUNT(*) AS total, " + ", ".join(
    f"MIN({a}) AS min_{a}, MAX({a}) AS max_{a}, MAX({a}) - MIN({a}) AS extent_{a}, (MAX({a}) + MIN({a})) / 2 AS centre_{a}"
    for a in "xyz") + " FROM points"))
def bounds(spark, folder):
    return layout.bounds(views.points(spark, folder))


@query("manifest", with_views("points", "classes", body=f"""
    SELECT COUNT(*) AS total, CAST(CEIL(COUNT(*) / {CHUNK}) AS BIGINT) AS n_chunks, {CHUNK} AS chunk_size,
           MIN(x) AS min_x, MAX(z) AS max_z,
           (SELECT STRING_AGG(f, ';' ORDER BY f) FROM (SELECT CONCAT(family, ':', STRING_AGG(label, '|' ORDER BY idx)) AS f
                                                      FROM classes GROUP BY family)) AS categories FROM points"""))
def manifest(spark, folder):
    row = layout.manifest(views.points(spark, folder), inputs.classes(spark), CHUNK)
    lists = F.transform("categories", lambda c: F.concat(c["family"], F.lit(":"), F.array_join(c["labels"], "|")))
    return row.select("total", "n_chunks", "chunk_size", F.col("coord_min")[0].alias("min_x"),
                      F.col("coord_max")[2].alias("max_z"), F.array_join(lists, ";").alias("categories"))


@query("recentre", with_views("points", body=_B + """
    SELECT id, ROUND(x - mx, 6) AS cx, ROUND(y - my, 6) AS cy, ROUND(z - mz, 6) AS cz,
           ROUND((x - (lx + hx) / 2) / span, 6) AS nx, ROUND((y - (ly + hy) / 2) / span, 6) AS ny,
           ROUND((z - (lz + hz) / 2) / span * 2, 6) AS wide_z FROM points, b"""))
def recentre(spark, folder):
    points = views.points(spark, folder).select("id", "x", "y", "z")
    centred = layout.recentred(points).select("id", *[F.round(a, 6).alias(f"c{a}") for a in "xyz"])
    unit = layout.normalised(points).select("id", F.round("x", 6).alias("nx"), F.round("y", 6).alias("ny"))
    wide = layout.normalised(points, 1.0).select("id", F.round("z", 6).alias("wide_z"))
    return centred.join(unit, "id").join(wide, "id")


@query("quantise", with_views("points", body=_B + """
    SELECT id, CAST(ROUND((x - lx) / span * 65535) AS INT) AS qx, CAST(ROUND((y - ly) / span * 65535) AS INT) AS qy,
           CAST(ROUND((z - lz) / span * 65535) AS INT) AS qz FROM points, b"""))
def quantise(spark, folder):
    return layout.quantised(views.points(spark, folder)).select("id", "qx", "qy", "qz")


_P = "p_partkey"


def _part_points(spark, folder):
    """A place for every part, from its size, price and key."""
    return views.table(spark, folder, "part").select(
        F.col(_P).alias("id"), F.col("p_size").cast("double").alias("x"),
        F.col("p_retailprice").alias("y"), (F.col(_P) % 64).cast("double").alias("z"))


_PART_POINTS = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_partkey % 64 AS DOUBLE) AS z FROM part"
_PART_ORDER = ", points AS (" + _PART_POINTS + ")" + _MORTON


@query("attributes", with_views("assignments", "classes", body=_PART_ORDER + f"""
    SELECT o.id, position // 500 AS chunk_id, {', '.join(f"CAST(COALESCE({f}.idx, 0) AS SMALLINT) AS {f}" for f in _FAMILIES)},
           CAST(ROUND((r.n_steps - 1) / 24.0, 5) AS DOUBLE) AS scalar
    FROM o JOIN recipes r ON r.id = o.id """ + " ".join(
        f"LEFT JOIN assignments {f} ON {f}.id = o.id AND {f}.family = '{f}'" for f in _FAMILIES)))
def attributes(spark, folder):
    placed = layout.z_ordered(_part_points(spark, folder))
    indexed = categories.with_class_index(inputs.assignments(spark, folder), inputs.classes(spark))
    rows = views.recipes(spark, folder)
    scaled = categories.scale_range(rows, RangeEncoder("n_steps", "n_steps"))
    scalar = scaled.select("id", F.round(F.element_at("vector", 1), 5).alias("scalar"))
    return layout.attributes(placed, indexed, _FAMILIES, scalar)


@query("wide_table", with_views("assignments", body=_PART_ORDER + f"""
    SELECT p.id, x, y, z, morton, position, position // 500 AS chunk_id, {', '.join(f"f_{f}.category AS label_{f}" for f in _FAMILIES)},
           r.name, r.submitted, c.avg_rating, c.n_ratings
    FROM points p JOIN o ON o.id = p.id JOIN recipes r ON r.id = p.id LEFT JOIN contrib c ON c.id = p.id """ + " ".join(
        f"LEFT JOIN assignments f_{f} ON f_{f}.id = p.id AND f_{f}.family = '{f}'" for f in _FAMILIES)))
def wide_table(spark, folder):
    from orrery.operators.ratings import contrib

    metadata = views.recipes(spark, folder).select("id", "name", "submitted")
    return layout.exploration_table(
        _part_points(spark, folder), inputs.assignments(spark, folder), _FAMILIES, metadata,
        contrib(views.interactions(spark, folder)))


@query("weighted_concat", with_views("records", "vectors", body=f"""
    SELECT v.id, 64 + 5 AS width, ROUND(5.0 * embedding[1], 6) AS first,
           CAST(CASE WHEN n_steps >= 21 THEN 1.3 ELSE 0 END AS DOUBLE) AS last
    FROM vectors v JOIN records r ON r.id = v.id"""))
def weighted_concat(spark, folder):
    encoder = [e for e in ENCODERS if e.field == "n_steps"]
    features = categories.encode_features(inputs.records(spark, folder), encoder)
    features = features.withColumn("family", F.lit("n_steps_features"))
    out = layout.augmented(views.embeddings(spark, folder), features, PROJECTION_WEIGHTS, ["n_steps_features"])
    return out.select("id", F.size("vector").alias("width"), F.round(F.element_at("vector", 1), 6).alias("first"),
                      F.round(F.element_at("vector", -1), 6).alias("last"))


@query("augmented_layout")
def augmented_layout(spark, folder):
    vectors = views.embeddings(spark, folder)
    features = categories.encode_features(inputs.records(spark, folder), ENCODERS)
    features = features.withColumn("family", F.concat("family", F.lit("_features")))
    families = sorted(f"{e}_features" for e in ("minutes", "n_steps", "avg_rating"))
    placed = layout.project(layout.augmented(vectors, features, PROJECTION_WEIGHTS, families), 3)
    return placed.select("id", *[F.round(a, 5).alias(a) for a in ("x", "y", "z")])


@query("argmax", with_views("vectors", body="""
    SELECT id, CAST(LIST_POSITION(embedding, LIST_MAX(embedding)) - 1 AS INT) AS best FROM vectors"""))
def argmax(spark, folder):
    return views.embeddings(spark, folder).select("id", V.argmax_index(F.col("embedding")).alias("best"))


@query("systematic_sample", with_views("points", body=_MORTON + """
    , n AS (SELECT COUNT(*) AS n FROM points), i AS (SELECT CAST(FLOOR(i * n / 60) AS BIGINT) AS position
          FROM (SELECT UNNEST(range(60)) AS i), n)
    SELECT id, position FROM o WHERE position IN (SELECT position FROM i)"""))
def systematic_sample(spark, folder):
    placed = layout.with_morton(views.points(spark, folder))
    return explore.systematic_sample(placed, ["morton", "id"], 60).select("id", "position")


@query("byte_chunks", """
    WITH RECURSIVE o AS (
        SELECT doc_id AS id, CAST(STRLEN(text) AS BIGINT) AS bytes, ROW_NUMBER() OVER (ORDER BY doc_id) AS r,
               SUM(COALESCE(STRLEN(text), 0)) OVER (ORDER BY doc_id) - COALESCE(STRLEN(text), 0) AS start
        FROM documents
    ), g AS (SELECT id, bytes, r, CAST(start // 800000 AS BIGINT) AS "range" FROM o),
    f AS (
        SELECT r, "range", CAST(0 AS BIGINT) AS chunk, COALESCE(bytes, 0) AS used FROM g WHERE r = 1
        UNION ALL
        SELECT g.r, g."range", CASE WHEN g."range" <> f."range" THEN 0 WHEN f.used + COALESCE(bytes, 0) > 100000 THEN f.chunk + 1 ELSE f.chunk END,
               CASE WHEN g."range" <> f."range" OR f.used + COALESCE(bytes, 0) > 100000 THEN COALESCE(bytes, 0) ELSE f.used + COALESCE(bytes, 0) END
        FROM f JOIN g ON g.r = f.r + 1
    )
    SELECT id, bytes, f."range", chunk FROM g JOIN f USING (r)""")
def byte_chunks(spark, folder):
    rows = views.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("bytes"))
    return layout.byte_chunks(rows, ["id"], "bytes", limit=100_000, range_chunks=8).select("id", "bytes", "range", "chunk")


@query("family_wide", with_views("assignments", body="""
    SELECT m.id, m.category AS minutes, s.category AS submitted, n.category AS n_ratings
    FROM assignments m JOIN assignments s ON m.id = s.id JOIN assignments n ON m.id = n.id
    WHERE m.family = 'minutes' AND s.family = 'submitted' AND n.family = 'n_ratings'"""))
def family_wide(spark, folder):
    return relate.families_wide(inputs.assignments(spark, folder), ["minutes", "submitted", "n_ratings"])
