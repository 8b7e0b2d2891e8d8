"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(sf_dir) / name}.parquet'")
    return con


def _plain(value):
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _key(row):
    return tuple("~" if v is None else repr(round(v, 4)) if isinstance(v, float) else repr(v)
                 for v in row)


def compare(df, con, sql: str) -> tuple[bool, str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    got = [tuple(_plain(r[c]) for c in order) for r in df.collect()]
    pick = [names.index(c) for c in order]
    want = [tuple(_plain(r[i]) for i in pick) for r in want]
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(order, a, b) if x != y]
            return False, f"first difference {str(diff)[:400]}"
    return True, f"{len(got)} rows"
