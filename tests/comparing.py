"""Run a registered query and its SQL and compare names, counts and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return "~"
        return repr(round(float(value), 5) + 0.0)
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(row[k]) for k in order) for row in rows)


def differences(spark, con, build, sql: str, sf_dir: str) -> tuple[int, str]:
    """(rows, '') when both agree, else (rows, what differs)."""
    frame = build(spark, sf_dir)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = _rows(columns, cursor.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return len(got), f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if got == want:
        return len(got), ""
    extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
    return len(got), f"rows {len(got)} != {len(want)}\n   spark: {extra}\n   sql:   {missing}"
