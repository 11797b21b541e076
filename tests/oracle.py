"""Run catalog queries on Spark and their SQL on DuckDB, and compare the rows.

Command line: ``python tests/oracle.py <sf folder> [--blocks N] [name part ...]``.
``--blocks N`` cuts series into blocks of N rows, so that small data crosses
block borders too.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame, cols: list[str]) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, (bool,)):
            return str(v)
        if isinstance(v, pd.Timestamp):
            return str(v.date()) if v == v.normalize() else str(v)
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return repr(v + 0.0) if not v.is_integer() else repr(int(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None))


def compare(left: pd.DataFrame, right: pd.DataFrame, rel: float | None = None) -> str:
    """'' when equal, else a short description of the first difference.

    With ``rel`` numbers may differ by that share of their size, or by one unit
    of their last rounded digit.
    """
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    cols = sorted(left.columns)
    if rel is not None:  # whole-valued columns first, so that both sides line up
        cols = sorted(cols, key=lambda c: (pd.api.types.is_float_dtype(left[c]), c))
    a, b = canonical(left, cols), canonical(right, cols)

    def close(p: str, q: str) -> bool:
        try:
            x, y = float(p), float(q)
        except ValueError:
            return False
        digits = max(len(v.partition(".")[2].partition("e")[0]) for v in (p, q))
        return abs(x - y) <= max(rel * max(abs(x), abs(y)), 1.1 * 10.0**-digits if "." in p + q and "e" not in p + q else 0.0)

    bad = [
        (x, y) for x, y in zip(a, b)
        if x != y and (rel is None or not all(p == q or close(p, q) for p, q in zip(x, y)))
    ]
    if not bad:
        return ""
    x, y = bad[0]
    cells = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
    return f"{len(bad)} rows differ, first: {x[:3]} {cells[:6]}"


def check(spark, con, folder, name, fn, sql, rel=None) -> tuple[str, float]:
    start = time.time()
    left = fn(spark, folder).toPandas()
    took = time.time() - start
    if sql is None:
        return ("" if len(left) else "no rows"), took
    return compare(left, con.execute(sql).df(), rel), took


def main() -> None:
    import __spark_entry__ as entry
    from tidemark.session import local_session

    folder, *parts = sys.argv[1:]
    if "--blocks" in parts:
        from tidemark.operators import layout

        at = parts.index("--blocks")
        layout.BLOCK_ROWS = layout.HALO_ROWS = int(parts[at + 1])
        del parts[at : at + 2]
    spark, con = local_session(), duck(folder)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            diff, took = check(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # report and go on with the next query
            diff, took = "ERROR " + str(e)[:300].replace("\n", " "), 0.0
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if not diff else 'FAIL'} {kind:4} {took:6.2f}s {name} {diff}", flush=True)


if __name__ == "__main__":
    main()
