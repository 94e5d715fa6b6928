"""Side-by-side comparison of a registered query with its SQL."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        return f"decimal:{value}"
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr
    )


def compare(spark, queries, oracles, name, sf_dir):
    """Empty string when equal, else a short account of the difference."""
    frame = queries[name](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    left = normal(frame.columns, rows)
    if name not in oracles:
        return "" if rows else "no rows"
    cursor = duck(sf_dir).execute(oracles[name])
    columns = [d[0] for d in cursor.description]
    right = normal(columns, cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}; e.g. {left[1][:2]} | {right[1][:2]}"
    if not rows:
        return "both empty"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if repr(a) != repr(b)]
    if wrong:
        ours, theirs = set(left[1]), set(right[1])
        only = [a for a in left[1] if a not in theirs][:2]
        other = [b for b in right[1] if b not in ours][:2]
        return f"{len(wrong)} of {len(rows)} differ; spark {only} | sql {other}"
    return ""
