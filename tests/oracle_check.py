"""Compare registered queries with their SQL; also runs as a script over given names."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0) if v != 0 else "0.0"
    return v if isinstance(v, (bool, int, str)) else str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, fn, sql):
    """None when equal, else a text saying what differs."""
    df = fn(spark, folder)
    got_cols, got = normal(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main(names):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from cohortis.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or qs:
        began = time.time()
        try:
            if name in sqls:
                fault = compare(spark, con, folder, name, qs[name], sqls[name])
            else:
                rows = qs[name](spark, folder).collect()
                fault = None
                print(f"     {name}: {len(rows)} rows, no SQL; {rows[:4]}")
        except Exception as e:  # noqa: BLE001 - report and go on
            fault = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += fault is not None
        print(f"{'FAIL' if fault else 'ok  '} {name} {time.time() - began:.2f}s {fault or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
