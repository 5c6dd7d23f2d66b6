"""Run registered queries against their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            if math.isnan(v):
                return "nan"
            return repr(v + 0.0) if v else "0.0"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        return repr(v) if not hasattr(v, "isoformat") else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    """None when equal, else a short account of the difference."""
    got_cols = df.columns
    got = normal([tuple(r) for r in df.collect()], got_cols)
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = normal(res.fetchall(), want_cols)
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} <> {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} <> {bad[0][1]}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from skyloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            note = compare(df, con, sql[name]) if name in sql else f"no sql, {len(df.collect())} rows"
        except Exception as exc:  # report and go on with the next query
            note = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        bad = note is not None and not note.startswith("no sql")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name:34s} {time.time() - start:6.2f}s {note or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:]) else 0)
