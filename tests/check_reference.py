"""Compare registered queries with their reference SQL. Usage: check_reference.py <data folder> [query ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caseflow.plans.adapters import TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v if isinstance(v, (int, str, bool)) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def compare(spark_df, con, sql):
    """Empty text when both give the same rows; else what differs."""
    got, got_names = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want, want_names = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} vs {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w or any(type(x) is not type(y) for x, y in zip(g, w))]
    return f"{len(diff)} of {len(got)} rows differ, e.g. {diff[0]} ({got_names})" if diff else ""


def main(folder, only):
    import __spark_entry__ as entry
    from caseflow.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            if name in sqls:
                msg = compare(fn(spark, folder), con, sqls[name])
            else:
                msg = "" if fn(spark, folder).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(msg)
        print(f"{'ok  ' if not msg else 'FAIL'} {name} {time.time() - t0:.1f}s {'' if name in sqls else '(rows only)'} {msg}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main(sys.argv[1], set(sys.argv[2:]))
