"""Runs a query and its SQL twin on the same tables and compares rows as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connection(folder: str):
    connected = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connected.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connected


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, folder: str, query, sql: str, connected=None) -> str | None:
    """None when both agree, else what differs."""
    frame = query(spark, folder)
    ours = frame.collect()
    connected = connected or connection(folder)
    result = connected.execute(sql)
    names = [d[0] for d in result.description]
    loose = [f"{d[0]} {d[1]}" for d in result.description if str(d[1]).startswith(("DECIMAL", "HUGEINT"))]
    if loose:
        return f"SQL types to cast: {loose}"
    theirs = result.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    left, right = multiset(frame.columns, ours), multiset(names, theirs)
    if left != right:
        only_left, only_right = left - right, right - left
        return (
            f"{len(ours)} against {len(theirs)} rows; only here {sum(only_left.values())}: "
            f"{list(only_left)[:3]}; only in SQL {sum(only_right.values())}: {list(only_right)[:3]}"
        )
    return None
