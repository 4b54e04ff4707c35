"""Compare a registered query with its DuckDB oracle: columns, row count, values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(frame, connection, sql: str) -> str:
    """Empty if equal, else a short account."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns: spark {sorted(frame.columns)} oracle {sorted(names)}"
    rows = frame.collect()
    mine, theirs = _bag(frame.columns, rows), _bag(names, expected)
    if mine == theirs:
        return ""
    extra, missing = mine - theirs, theirs - mine
    return (
        f"rows spark {len(rows)} oracle {len(expected)}; {sum(extra.values())} differ;"
        f" spark {list(extra)[:2]} oracle {list(missing)[:2]} columns {sorted(names)}"
    )
