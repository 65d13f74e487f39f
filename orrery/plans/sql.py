"""The views of ``orrery.sources.views`` as SQL, for the twins."""

from __future__ import annotations

from orrery.config import ENCODERS, BinEncoder

VIEWS = {
    "interactions": """
        SELECT CASE WHEN l_partkey % 20 = 0 THEN -l_partkey ELSE l_partkey END AS recipe_id,
               l_suppkey AS user_id,
               CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS date,
               CAST(l_quantity AS INT) % 6 AS rating
        FROM lineitem""",
    "recipes": """
        SELECT p_partkey AS id,
               CASE WHEN p_partkey % 97 <> 0 THEN p_name END AS name,
               CASE WHEN p_partkey % 31 <> 0 THEN p_size * 6 END AS minutes,
               CAST(p_partkey % 25 + 1 AS INT) AS n_steps,
               CAST(p_size % 24 + 1 AS INT) AS n_ingredients,
               CONCAT(CAST(1999 + p_partkey % 20 AS VARCHAR), '-06-15') AS submitted
        FROM part""",
    "recipe_tags": """
        SELECT p_partkey AS id, 'wide' AS tag FROM part WHERE p_size < 40
        UNION ALL SELECT p_partkey, 'mid' FROM part WHERE p_size < 25
        UNION ALL SELECT p_partkey, 'tiny' FROM part WHERE p_size < 10
        UNION ALL SELECT p_partkey, LOWER(p_type) FROM part""",
    "recipe_items": """
        SELECT l_partkey AS id, CONCAT('item-', CAST(l_suppkey % 40 AS VARCHAR)) AS ingredient FROM lineitem""",
    "baskets": """
        SELECT l_orderkey AS id, p_name AS ingredient FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "vectors": """
        SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings""",
    "points": """
        SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
               CAST(embedding[3] AS DOUBLE) AS z, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster
        FROM embeddings""",
    "papers": """
        SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS title,
               text AS abstract,
               CASE WHEN doc_id % 3 = 0 THEN CONCAT('10.1000/', CAST(doc_id AS VARCHAR))
                    WHEN doc_id % 3 = 1 THEN CONCAT(' https://doc.example/', CAST(doc_id AS VARCHAR), ' ') END AS doi
        FROM documents""",
    "contrib": """
        SELECT recipe_id AS id, ROUND(AVG(rating), 3) AS avg_rating, COUNT(*) AS n_ratings
        FROM interactions WHERE rating > 0 GROUP BY recipe_id""",
    "records": """
        SELECT r.*, c.avg_rating, c.n_ratings FROM recipes r LEFT JOIN contrib c ON r.id = c.id""",
}
NEEDS = {"contrib": ("interactions",), "records": ("recipes", "contrib")}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def value_sql(encoder: BinEncoder) -> str:
    if encoder.field == "submitted":
        raw = "CAST(SUBSTR(submitted, 1, 4) AS DOUBLE)"
    else:
        raw = f"CAST({encoder.field} AS DOUBLE)"
    return f"COALESCE({raw}, {encoder.missing.value})" if encoder.missing.value is not None else raw


def bin_sql(encoder: BinEncoder, value: str) -> str:
    steps = " ".join(f"WHEN {value} < {edge} THEN {i}" for i, edge in enumerate(encoder.edges))
    return f"CASE {steps} ELSE {len(encoder.edges)} END"


def _family_sql(encoder: BinEncoder) -> str:
    shift = 1 if encoder.missing.label else 0
    labels = " ".join(f"WHEN {i} THEN {text(label)}" for i, label in enumerate(encoder.classes))
    score = f"ROUND(bin / {float(len(encoder.edges))}, 4)" if encoder.scalar else "1.0"
    absent = "0.0" if encoder.missing.label else "0.5"
    value = value_sql(encoder)
    return f"""
        SELECT id, '{encoder.field}' AS family, CASE idx {labels} END AS category,
               CAST(CASE WHEN bin IS NULL THEN {absent} ELSE {score} END AS DOUBLE) AS score, idx
        FROM (SELECT id, bin, CASE WHEN bin IS NULL THEN 0 ELSE bin + {shift} END AS idx
              FROM (SELECT id, CASE WHEN v IS NOT NULL THEN {bin_sql(encoder, 'v')} END AS bin
                    FROM (SELECT id, {value} AS v FROM records)))"""


VIEWS["assignments"] = " UNION ALL ".join(_family_sql(e) for e in ENCODERS)
NEEDS["assignments"] = ("records",)
VIEWS["classes"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{e.field}', {i}, {text(label)})" for e in ENCODERS for i, label in enumerate(e.classes)
) + ") AS c(family, idx, label)"


def with_views(*names: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named views, and what they read, in front of it."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for below in NEEDS.get(name, ()):
            add(below)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({VIEWS[name]})" for name in ordered]
    start = "WITH RECURSIVE " if recursive else "WITH "
    return (start + ",\n".join(parts) + "\n" + body) if parts else body


def dense_sql(eps: str, min_samples: str, min_size: int) -> str:
    """Density clusters of ``points`` by comparing all pairs; to follow the view, in a recursive statement."""
    return f"""
    , p AS (SELECT id, x, y, z FROM points),
    size AS (SELECT COUNT(*) AS n, GREATEST(MAX(x) - MIN(x), 1e-9) * GREATEST(MAX(y) - MIN(y), 1e-9) * GREATEST(MAX(z) - MIN(z), 1e-9) AS volume FROM p),
    rule AS (SELECT n, volume, {min_samples} AS least FROM size),
    eps AS (SELECT least, {eps} AS eps FROM rule),
    near AS (SELECT a.id AS a, b.id AS b FROM eps, p a JOIN p b ON TRUE
             WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= eps * eps),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING COUNT(*) >= (SELECT least FROM eps)),
    link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS reached FROM core UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.reached = link.a),
    part AS (SELECT id, MIN(reached) AS part, COUNT(*) AS n FROM reach GROUP BY id),
    place AS (SELECT part, ROW_NUMBER() OVER (ORDER BY n DESC, part) - 1 AS cluster
              FROM (SELECT DISTINCT part, n FROM part WHERE n >= {min_size}))
    SELECT p.id, CAST(COALESCE(cluster, -1) AS INT) AS cluster FROM p LEFT JOIN part ON part.id = p.id LEFT JOIN place ON place.part = part.part"""
