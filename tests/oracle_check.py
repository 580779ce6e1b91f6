"""Run registered queries against their reference SQL in DuckDB.

    python -m tests.oracle_check [sf_dir] [key ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return f"{v:.6f}".rstrip("0").rstrip(".") if v != int(v) or abs(v) > 1e15 else str(int(v))
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted([tuple(canon(r[i]) for i in order) for r in rows], key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    exp_cols, exp = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != exp_cols:
        return f"columns {got_cols} != {exp_cols}"
    if len(got) != len(exp):
        a, b = [r for r in got if r not in set(exp)][:2], [r for r in exp if r not in set(got)][:2]
        return f"rows {len(got)} != {len(exp)}: spark only {str(a)[:400]} oracle only {str(b)[:400]}"
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ: {str(bad[0][0])[:500]} != {str(bad[0][1])[:500]}"
    return None if got else "no rows"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from hitweave.session import build_session, clear_shared

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, oracles = connect(sf), queries(), oracle_sql()
    bad = 0
    for key in args or qs:
        t = time.time()
        try:
            df = qs[key](spark, sf)
            if key in oracles:
                diff = compare(df, con, oracles[key])
                state = "ok" if diff is None else f"DIFF {diff}"
            else:
                n = len(df.collect())
                state = f"rows {n}" if n else "DIFF no rows"
        except Exception as e:  # noqa: BLE001
            state = f"FAIL {type(e).__name__}: {str(e)[:700]}"
        bad += not state.startswith(("ok", "rows"))
        print(f"{key:32s} {time.time() - t:6.1f}s {state}", flush=True)
    clear_shared(spark)
    print("bad:", bad)


if __name__ == "__main__":
    main()
