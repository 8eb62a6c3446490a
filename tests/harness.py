"""Runs queries beside their SQL: python tests/harness.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(names: list[str], rows: list) -> list[tuple]:
    """Rows with columns in order of name, sorted, floats to 9 digits."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def norm(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x + 0.0, 9)
        if isinstance(x, (list, tuple)):
            return tuple(norm(y) for y in x)
        return x

    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[str, int]:
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "no sql", len(got)
    rel = con.sql(sql)
    cols = rel.columns
    want = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(cols)}", len(got)
    if got != want:
        bad = next((i for i, (a, b) in enumerate(zip(got, want)) if a != b), min(len(got), len(want)))
        return f"rows {len(got)} / {len(want)}: {got[bad:bad + 1]} / {want[bad:bad + 1]}", len(got)
    return "ok", len(got)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry
    from metrolith.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:] and not any(name.startswith(x[:-1]) for x in sys.argv[2:] if x.endswith("*")):
            continue
        t = time.time()
        try:
            said, n = compare(spark, con, fn, sqls.get(name), sys.argv[1])
        except Exception as e:
            said, n = f"ERROR {type(e).__name__}: {str(e)[:600]}", -1
        print(f"{name}: {said} ({n} rows, {time.time() - t:.1f} s)", flush=True)
