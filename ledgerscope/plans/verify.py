"""Compare a Spark result with the DuckDB oracle: column names, row count and
order-insensitive values (floats to 1e-9 relative)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _sort_key(row):
    return tuple((0, "") if v is None else
                 (1, f"{v:.6e}" if isinstance(v, (int, float)) and not isinstance(v, bool)
                  else repr(v)) for v in row)


def _same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare_rows(s_cols, s_rows, d_cols, d_rows):
    """Returns (ok, message, row_count)."""
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} oracle={d_cols}", len(s_rows)
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    a_rows = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_sort_key)
    b_rows = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_sort_key)
    if len(a_rows) != len(b_rows):
        return False, f"rows differ: spark={len(a_rows)} oracle={len(b_rows)}", len(a_rows)
    exact = True
    for a, b in zip(a_rows, b_rows):
        for c, x, y in zip(order, a, b):
            if not _same(x, y):
                return False, f"{c}: spark={x!r} oracle={y!r}", len(a_rows)
            exact &= x == y
    return True, "exact" if exact else "close", len(a_rows)


def compare(spark_df, con, sql: str):
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    s_rows = [tuple(r) for r in spark_df.collect()]
    return compare_rows(list(spark_df.columns), s_rows, d_cols, d_rows)
