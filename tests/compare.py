"""Run registered queries on Spark and as SQL on DuckDB and compare all rows."""

from __future__ import annotations

import datetime
import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:10]
    if isinstance(v, float):
        return repr(v)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str):
    """(number of rows, list of differences)."""
    got_names = spark_df.columns
    got = _rows(got_names, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = _rows(want_names, cur.fetchall())
    if sorted(got_names) != sorted(want_names):
        return len(got), [("columns", sorted(got_names), sorted(want_names))]
    if len(got) != len(want):
        return len(got), [("rows", len(got), len(want))]
    return len(got), [(g, w) for g, w in zip(got, want) if g != w]


if __name__ == "__main__":
    import sys

    sys.path.insert(0, ".")
    from matchlake.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.log.level": "ERROR"}
    )
    import __spark_entry__ as e

    con = duck(sf)
    sqls = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                n, diff = compare(fn(spark, sf), con, sqls[name])
                state = "ok" if not diff else f"DIFF {len(diff)} {diff[:2]}"
                bad += bool(diff)
            else:
                n, state = len(fn(spark, sf).collect()), "rows only"
        except Exception as err:
            n, state = -1, f"ERROR {type(err).__name__} {str(err)[:600]}"
            bad += 1
        print(f"{name:32s} {n:7d} {time.time() - t:6.2f}s {state}", flush=True)
    print("bad:", bad)
