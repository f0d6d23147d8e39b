"""Order-insensitive comparison of a Spark result with a DuckDB oracle:
row count, sorted column names, multiset of rows (floats rounded)."""

from __future__ import annotations

import math


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return canon(v.item())
    try:
        from decimal import Decimal
        if isinstance(v, Decimal):
            return round(float(v), 6) + 0.0
    except Exception:  # pragma: no cover
        pass
    return v


def rows_of(records, cols):
    out = [tuple(canon(r[c]) for c in cols) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(sdf, con, sql):
    """Return None when equal, else a short description of the difference."""
    srows = [r.asDict() for r in sdf.collect()]
    scols = sorted(sdf.columns)
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
    if sorted(dcols) != scols:
        return f"columns spark={scols} duck={sorted(dcols)}"
    a, b = rows_of(srows, scols), rows_of(drows, scols)
    if len(a) != len(b):
        return f"rows spark={len(a)} duck={len(b)}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"values differ, e.g. {diff}"
    return None


def duck_views(sf_dir: str):
    import duckdb

    from .fixtures import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con
