"""Nearest neighbours, classification, similar groups and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import clusters, density, graphs, layout, neighbours, spanning, spectral
from orrery.plans.registry import query
from orrery.plans.sql import dense_sql, with_views
from orrery.session import cut
from orrery.sources import views

K = 10
EDGE_THRESHOLD = 0.4

_DIST = """
    , tr AS (SELECT * FROM vectors WHERE label <> 0),
    d AS (SELECT q.id AS query_id, t.id AS neighbour_id, t.label, q.label <> 0 AS tagged,
                 ROUND(1 - LIST_DOT_PRODUCT(q.embedding, t.embedding)
                       / (SQRT(LIST_DOT_PRODUCT(q.embedding, q.embedding)) * SQRT(LIST_DOT_PRODUCT(t.embedding, t.embedding))), 12) AS d
          FROM vectors q CROSS JOIN tr t WHERE {where}),
    n AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS r FROM d) WHERE r <= 10)"""
_NEIGHBOURS = " SELECT query_id, neighbour_id, CAST(r AS INT) AS rank, ROUND(d, 6) AS distance FROM n"


def _vectors(spark, folder):
    """All vectors, and those with a label: label 0 stands for untagged."""
    rows = views.embeddings(spark, folder)
    return rows, rows.filter(F.col("label") != 0)


def _rounded(found):
    return found.select("query_id", "neighbour_id", "rank", F.round("distance", 6).alias("distance"))


@query("knn", with_views("vectors", body=_DIST.format(where="TRUE") + _NEIGHBOURS))
def knn(spark, folder):
    rows, train = _vectors(spark, folder)
    return _rounded(neighbours.nearest(rows, train, K))


@query("knn_blocks", with_views("vectors", body=_DIST.format(where="TRUE") + _NEIGHBOURS))
def knn_blocks(spark, folder):
    """The same join in its form for training sides too large to broadcast."""
    rows, train = _vectors(spark, folder)
    return _rounded(neighbours.nearest(rows, train, K, broadcast_bytes=0, block_rows=200))


@query("knn_loo", with_views("vectors", body=_DIST.format(where="q.id <> t.id") + _NEIGHBOURS))
def knn_loo(spark, folder):
    rows, train = _vectors(spark, folder)
    return _rounded(neighbours.nearest(rows, train, K, skip_self=True))


@query("knn_graph", with_views("vectors", body="""
    , d AS (SELECT a.id, b.id AS neighbour, ROUND(1 - LIST_DOT_PRODUCT(a.embedding, b.embedding)
                 / (SQRT(LIST_DOT_PRODUCT(a.embedding, a.embedding)) * SQRT(LIST_DOT_PRODUCT(b.embedding, b.embedding))), 12) AS d
            FROM vectors a CROSS JOIN vectors b WHERE a.id <> b.id)
    SELECT id, neighbour, CAST(r AS INT) AS rank, ROUND(d, 6) AS distance
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY d, neighbour) AS r FROM d) WHERE r <= 15"""))
def knn_graph(spark, folder):
    return neighbours.graph(views.embeddings(spark, folder), 15).withColumn("distance", F.round("distance", 6))


_PROBA = """
    , v AS (SELECT query_id, label, tagged, COUNT(CASE WHEN d <= 1e-12 AND NOT tagged THEN 1 END) AS z,
                   SUM(CASE WHEN tagged THEN 1 / GREATEST(d, 1e-10) WHEN d > 1e-12 THEN 1 / d ELSE 0 END) AS w
            FROM n GROUP BY ALL),
    p AS (SELECT query_id, label, CASE WHEN SUM(z) OVER (PARTITION BY query_id) > 0
                 THEN z / SUM(z) OVER (PARTITION BY query_id) ELSE w / SUM(w) OVER (PARTITION BY query_id) END AS p FROM v),
    pr AS (SELECT label, COUNT(*) / SUM(COUNT(*)) OVER () AS prior FROM tr GROUP BY label),
    c AS (SELECT query_id, p.label, (p / prior) / SUM(p / prior) OVER (PARTITION BY query_id) AS p FROM p JOIN pr ON p.label = pr.label)"""


@query("knn_proba", with_views("vectors", body=_DIST.format(where="q.id <> t.id") + _PROBA + """
    SELECT query_id, CAST(label AS VARCHAR) AS label, ROUND(p, 5) AS p FROM c"""))
def knn_proba(spark, folder):
    rows, train = _vectors(spark, folder)
    found = neighbours.assign(rows, train.select("id", "label"), K)
    classes = sorted(neighbours.priors(train.select("id", F.col("label").cast("string").alias("label"))))
    names = F.array(*[F.lit(c) for c in classes])
    cells = found.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip(names.alias("label"), F.col("proba").alias("p"))).alias("c"))
    return cells.select("query_id", F.col("c.label").alias("label"), F.round("c.p", 5).alias("p")).filter("p > 0")


@query("assign", with_views("vectors", body=_DIST.format(where="q.id <> t.id") + _PROBA + """
    , k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY p DESC, CAST(label AS VARCHAR)) AS r FROM c)
    SELECT query_id AS id, MAX(CASE WHEN r = 1 AND p >= 0.3 THEN CAST(label AS VARCHAR) END) AS category,
           MAX(CASE WHEN r = 1 THEN ROUND(p, 4) END) AS score,
           MAX(CASE WHEN r = 2 THEN CAST(label AS VARCHAR) END) AS second, MAX(CASE WHEN r = 3 THEN CAST(label AS VARCHAR) END) AS third
    FROM k GROUP BY query_id"""))
def assign(spark, folder):
    rows, train = _vectors(spark, folder)
    found = neighbours.assign(rows, train.select("id", "label"), K, min_score=0.3)
    second, third = F.try_element_at("runners_up", F.lit(1)), F.try_element_at("runners_up", F.lit(2))

    def named(runner):
        return F.when(runner["score"] > 0, runner["category"])

    return found.select("id", "category", "score", named(second).alias("second"), named(third).alias("third"))


_EDGES = f"""
    , u AS (SELECT id, embedding, SQRT(LIST_DOT_PRODUCT(embedding, embedding)) AS norm FROM vectors),
    e AS (SELECT a.id AS a, b.id AS b, ROUND(LIST_DOT_PRODUCT(a.embedding, b.embedding) / (a.norm * b.norm), 6) AS similarity
          FROM u a JOIN u b ON a.id < b.id
          WHERE LIST_DOT_PRODUCT(a.embedding, b.embedding) / (a.norm * b.norm) >= {EDGE_THRESHOLD})"""


@query("sim_edges", with_views("vectors", body=_EDGES + " SELECT * FROM e"))
def sim_pairs(spark, folder):
    """All pairs, those of exact copies too: the edges of distinct vectors expanded by the table of copies."""
    points = views.embeddings(spark, folder).select("id", "embedding")
    edges = graphs.similar_edges(points, EDGE_THRESHOLD)
    pairs = graphs.all_pairs(edges, graphs.representatives(points))
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("sim_edges_members", with_views("vectors", body=f"""
    , u AS (SELECT MIN(id) AS id, embedding, SQRT(LIST_DOT_PRODUCT(embedding, embedding)) AS norm FROM vectors GROUP BY embedding)
    SELECT 'pair' AS kind, a.id AS a, b.id AS b, ROUND(LIST_DOT_PRODUCT(a.embedding, b.embedding) / (a.norm * b.norm), 6) AS similarity
    FROM u a JOIN u b ON a.id < b.id
    WHERE LIST_DOT_PRODUCT(a.embedding, b.embedding) / (a.norm * b.norm) >= {EDGE_THRESHOLD}
    UNION ALL SELECT 'member', u.id, v.id, CAST(NULL AS DOUBLE) FROM vectors v JOIN u ON v.embedding = u.embedding"""))
def sim_edges(spark, folder):
    """Two tables as rows: the pairs of distinct vectors (``pair``) and who each of them stands for (``member``)."""
    points = views.embeddings(spark, folder).select("id", "embedding")
    edges = graphs.similar_edges(points, EDGE_THRESHOLD)
    pairs = edges.select(F.lit("pair").alias("kind"), "a", "b", F.round("similarity", 6).alias("similarity"))
    members = graphs.representatives(points).select(
        F.lit("member").alias("kind"), F.col("representative").alias("a"), F.col("id").alias("b"),
        F.lit(None).cast("double").alias("similarity"))
    return pairs.unionByName(members)


_COPIED = _EDGES.replace("vectors", "copied")


@query("sim_edges_copies", with_views("vectors", body="""
    , copied AS (SELECT id, embedding FROM vectors UNION ALL SELECT -id - 1, embedding FROM vectors WHERE id % 10 = 0)
    """ + _COPIED + " SELECT * FROM e"))
def sim_edges_copies(spark, folder):
    """All pairs when every tenth vector is there twice, from the edges (over cells) and the table of copies."""
    points = views.embeddings(spark, folder).select("id", "embedding")
    again = points.filter("id % 10 = 0").withColumn("id", -F.col("id") - 1)
    copied = points.unionByName(again)
    edges = graphs.similar_edges(copied, EDGE_THRESHOLD, broadcast_bytes=0, block_rows=100)
    pairs = graphs.all_pairs(edges, graphs.representatives(copied))
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("merge_groups", with_views("vectors", recursive=True, body=_EDGES + """
    , s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    w AS (SELECT id AS a, id AS b FROM vectors UNION SELECT w.a, s.b FROM w JOIN s ON w.b = s.a),
    m AS (SELECT a AS id, MIN(b) AS component FROM w GROUP BY a)
    SELECT id, component, DENSE_RANK() OVER (ORDER BY component) - 1 AS "group" FROM m"""))
def merge_groups(spark, folder):
    return clusters.merged_groups(views.embeddings(spark, folder), EDGE_THRESHOLD)


@query("l2", with_views("vectors", body="""
    SELECT id, ROUND(SQRT(LIST_DOT_PRODUCT(embedding, embedding)), 6) AS norm,
           ROUND(3 * embedding[1] / GREATEST(3 * SQRT(LIST_DOT_PRODUCT(embedding, embedding)), 1e-9), 6) AS first
    FROM vectors"""))
def l2(spark, folder):
    vector = F.col("embedding")
    unit = V.l2_normalised(V.scaled(vector, 3.0))
    return views.embeddings(spark, folder).select(
        "id", F.round(F.sqrt(V.dot(vector, vector)), 6).alias("norm"), F.round(F.element_at(unit, 1), 6).alias("first"))


@query("dbscan", with_views("points", recursive=True, body=dense_sql(
    "GREATEST(1e-9, POW(volume * least / n * 3.0 / (4.0 * PI()), 1.0 / 3.0))",
    "GREATEST(5, LEAST(50, GREATEST(10, LEAST(500, n // 500)) // 5))", 3)))
def dbscan(spark, folder):
    points = views.points(spark, folder).select("id", "x", "y", "z")
    total = points.count()
    _, min_samples = density.auto_sizes(total)
    return density.dbscan(points, density.auto_eps(points, min_samples), min_samples, min_size=3)


@query("pca_layout")
def pca_layout(spark, folder):
    vectors = views.embeddings(spark, folder).select("id", F.col("embedding").alias("vector"))
    return layout.project(vectors, 3).select("id", *[F.round(a, 6).alias(a) for a in ("x", "y", "z")])


@query("spectral_layout")
def spectral_layout(spark, folder):
    """Coordinates that keep neighbourhoods, from the neighbour table of all vectors."""
    placed = spectral.layout(neighbours.graph(views.embeddings(spark, folder), 15), 2, cycles=3)
    return placed.select("id", *[F.round(a, 6).alias(a) for a in ("x", "y")])


def _grouped_documents(spark, folder, *keys):
    """All documents, clustered by the values of some columns."""
    digits = F.substring(F.md5(F.concat_ws("/", *keys)), 1, 7)
    number = F.conv(digits, 16, 10).cast("int") % 10**6
    return views.table(spark, folder, "documents").select(number.alias("cluster"), "text")


@query("cluster_terms", """
    WITH d AS (SELECT CAST(CAST('0x' || SUBSTR(MD5(COALESCE(source, '')), 1, 7) AS BIGINT) % 1000000 AS INT) AS cluster, text FROM documents),
    w AS (SELECT cluster, UNNEST(REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{L}\\p{N}]+')) AS term FROM d),
    tf AS (SELECT cluster, term, COUNT(*) AS tf FROM w WHERE LENGTH(term) >= 3 GROUP BY ALL),
    df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term),
    s AS (SELECT cluster, term, ROUND(tf * LN((SELECT COUNT(DISTINCT cluster) FROM tf) / df), 9) AS weight FROM tf JOIN df USING (term)),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS r FROM s)
    SELECT c.cluster, COALESCE(STRING_AGG(term, ' ' ORDER BY r), 'Cluster ' || c.cluster) AS name
    FROM (SELECT DISTINCT cluster FROM d) c LEFT JOIN r ON r.cluster = c.cluster AND r <= 3 GROUP BY c.cluster""")
def cluster_terms(spark, folder):
    docs = _grouped_documents(spark, folder, "source")
    return clusters.filled_names(docs, clusters.distinctive_terms(docs))


@query("knn_votes", with_views("vectors", body=_DIST.format(where="TRUE") + """
    , v AS (SELECT query_id, label, COUNT(CASE WHEN d <= 1e-12 THEN 1 END) AS z,
                   SUM(CASE WHEN d > 1e-12 THEN 1 / d ELSE 0 END) AS w FROM n GROUP BY ALL)
    SELECT query_id, CAST(label AS VARCHAR) AS label,
           ROUND(CASE WHEN SUM(z) OVER (PARTITION BY query_id) > 0 THEN z / SUM(z) OVER (PARTITION BY query_id)
                      ELSE w / SUM(w) OVER (PARTITION BY query_id) END, 5) AS p FROM v"""))
def knn_votes(spark, folder):
    """Votes of plain queries: a labelled row finds itself at distance 0, and only it counts."""
    rows, train = _vectors(spark, folder)
    found = neighbours.nearest(rows, train, K, carry_train="label")
    return neighbours.votes(found).withColumn("p", F.round("p", 5))


@query("class_priors", with_views("vectors", body="""
    SELECT CAST(label AS VARCHAR) AS label, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS prior
    FROM vectors WHERE label <> 0 GROUP BY label"""))
def class_priors(spark, folder):
    _, train = _vectors(spark, folder)
    shares = neighbours.priors(train.select(F.col("label").cast("string").alias("label")))
    return spark.createDataFrame(list(shares.items()), "label string, prior double").withColumn("prior", F.round("prior", 6))


@query("meta_groups")
def meta_groups(spark, folder):
    docs = _grouped_documents(spark, folder, "source", "lang")
    names = cut(clusters.filled_names(docs, clusters.distinctive_terms(docs, 6)))
    return clusters.meta_groups(names, 0.5)


@query("meta_group_names")
def meta_group_names(spark, folder):
    docs = _grouped_documents(spark, folder, "source", "lang")
    names = cut(clusters.filled_names(docs, clusters.distinctive_terms(docs, 6)))
    return clusters.group_names(clusters.meta_groups(names, 0.5), names)


NEAR, SAMPLES, LEAST = 12, 4, 3
_REACH = """
    , n AS (SELECT * FROM (SELECT a, b, d, ROW_NUMBER() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) WHERE r <= 12),
    core AS (SELECT a AS id, d AS core FROM n WHERE r = 3),
    e AS (SELECT LEAST(a, b) AS a, GREATEST(a, b) AS b, MIN(GREATEST(d, x.core, y.core)) AS w
          FROM n JOIN core x ON x.id = a JOIN core y ON y.id = b GROUP BY ALL),
    eps AS (SELECT level, factor * AVG(core) AS eps FROM core, (VALUES {levels}) f(level, factor) GROUP BY level, factor),
    l AS (SELECT level, a, b FROM e JOIN eps ON w <= eps + 1e-9),
    s AS (SELECT * FROM l UNION SELECT level, b, a FROM l),
    t AS (SELECT DISTINCT level, a AS id, a AS reached FROM s
          UNION SELECT t.level, t.id, s.b FROM t JOIN s ON t.level = s.level AND t.reached = s.a),
    m AS (SELECT level, id, MIN(reached) AS part, COUNT(*) AS size FROM t GROUP BY level, id),
    k AS (SELECT level, part, DENSE_RANK() OVER (PARTITION BY level ORDER BY size DESC, part) - 1 AS cluster
          FROM (SELECT DISTINCT level, part, size FROM m WHERE size >= 3))
    SELECT CAST(eps.level AS INT) AS level, p.id, CAST(COALESCE(k.cluster, -1) AS INT) AS cluster
    FROM eps CROSS JOIN points_ p LEFT JOIN m ON m.level = eps.level AND m.id = p.id
         LEFT JOIN k ON k.level = m.level AND k.part = m.part"""


def _by_level(table, factors):
    """Clusters of a neighbour table at multiples of the mean core distance."""
    table = cut(table)
    forest = spanning.spanning_forest(spanning.reachability(table, SAMPLES))
    mean = table.filter(F.col("rank") == SAMPLES - 1).agg(F.avg("distance")).first()[0]
    points = table.select("id").distinct()
    return spanning.clusters_by_level(points, forest, [factor * mean + 1e-9 for factor in factors], LEAST)


@query("dense_vectors", with_views("vectors", recursive=True, body="""
    , points_ AS (SELECT id FROM vectors),
    d AS (SELECT a.id AS a, b.id AS b, ROUND(1 - LIST_DOT_PRODUCT(a.embedding, b.embedding)
                 / (SQRT(LIST_DOT_PRODUCT(a.embedding, a.embedding)) * SQRT(LIST_DOT_PRODUCT(b.embedding, b.embedding))), 12) AS d
          FROM vectors a JOIN vectors b ON a.id <> b.id)""" + _REACH.format(levels="(0, 0.9), (1, 1.0), (2, 1.1)")))
def dense_vectors(spark, folder):
    """Density clusters of whole vectors at three densities."""
    return _by_level(neighbours.graph(views.embeddings(spark, folder), NEAR, broadcast_bytes=0, block_rows=200), (0.9, 1.0, 1.1))


@query("dense_plane", with_views("points", recursive=True, body="""
    , points_ AS (SELECT id FROM points),
    d AS (SELECT a.id AS a, b.id AS b, ROUND(SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 12) AS d
          FROM points a JOIN points b ON a.id <> b.id)""" + _REACH.format(levels="(0, 0.7), (1, 1.0), (2, 1.5)")))
def dense_plane(spark, folder):
    """Density clusters of points in the plane at three densities."""
    places = views.points(spark, folder).select("id", F.array("x", "y").alias("embedding"))
    return _by_level(neighbours.graph(places, NEAR, broadcast_bytes=0, block_rows=200, straight=True), (0.7, 1.0, 1.5))
