"""python tests/compare.py SF_DIR [NAME...]: runs queries beside their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(p)[: -len(".parquet")]
        con.sql(f"create view {name} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def canon(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return v if v is None else str(v)


def bag(columns: list[str], rows: list) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canon(r[i]) for i in order) for r in rows)


def sql_bag(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    rel = con.sql(sql)
    return bag(rel.columns, rel.fetchall())


def spark_bag(df) -> tuple[list[str], Counter]:
    return bag(df.columns, df.collect())


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E

    from stemma.session import session

    spark = session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    qs, sq = E.queries(), E.oracle_sql()
    con = views(sf)
    bad = 0
    for name in names or qs:
        t = time.time()
        try:
            c, a = spark_bag(qs[name](spark, sf))
            t1 = time.time() - t
            if name not in sq:
                print(f"rows  {name} {sum(a.values())} {t1:.1f}s", flush=True)
                continue
            t = time.time()
            c2, b = sql_bag(con, sq[name])
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {name}: {str(e)[:700]}", flush=True)
            bad += 1
            continue
        ok = c == c2 and a == b
        bad += not ok
        print(f"{'ok   ' if ok else 'DIFF '} {name} {sum(a.values())} {sum(b.values())} {t1:.1f}s sql {time.time() - t:.1f}s", flush=True)
        if not ok:
            print("   ", c, c2, "\n    only spark", list((a - b).items())[:4], "\n    only sql  ", list((b - a).items())[:4], sum((a - b).values()), sum((b - a).values()), flush=True)
    print("bad", bad)
    os._exit(bad > 0)
