"""Run registered queries next to their SQL and compare values; usable as a script: oracle.py [sf] [name-part ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql, folder):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows {len(got)}"
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"FAIL columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"FAIL rows spark {len(got)} duck {len(want)}; e.g. {[x for x in got if x not in want[:5000]][:2]} / {[x for x in want if x not in got[:5000]][:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"FAIL {len(bad)} of {len(got)} rows; {sorted(df.columns)} e.g. spark {bad[0][0]} duck {bad[0][1]}"
    return f"ok {len(got)}"


if __name__ == "__main__":
    from stagelight.session import build_session
    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = e.queries(), e.oracle_sql()
    for n, fn in qs.items():
        if parts and not any(n == p or n.startswith(p + "_") for p in parts):
            continue
        t = time.time()
        try:
            folder = f"/root/testdata/sf{sf}"
            res = compare(fn(spark, folder), sqls.get(n), folder)
        except Exception as ex:
            res = "ERROR " + str(ex)[:600]
        print(f"{n:40s} {time.time() - t:6.2f}s {res}", flush=True)
