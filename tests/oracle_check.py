"""Run registered queries on Spark and their SQL on DuckDB and compare values (names sorted)."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(v):
    if isinstance(v, (bool, type(None), str)):
        return v
    if isinstance(v, Decimal):
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float) and v == int(v) and abs(v) < 2**53:
        return int(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"{name}: rows-only {len(got)} ({t1 - t0:.1f}s)", True
    cur = con.execute(sql)
    want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    ok = cols == wcols and got == want
    msg = f"{'ok  ' if ok else 'FAIL'} {name}: {len(got)} rows ({t1 - t0:.1f}s / {t2 - t1:.1f}s)"
    if not ok:
        if cols != wcols:
            msg += f"\n   columns {cols} vs {wcols}"
        else:
            a, b = set(map(repr, got)), set(map(repr, want))
            msg += f"\n   want {len(want)} rows; spark-only {list(a - b)[:2]}\n   duck-only {list(b - a)[:2]}"
    return msg, ok


def main():
    from spanmill.session import build_session
    import __spark_entry__ as e
    sf = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.01")
    pats = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con, q, o, bad = duck(sf), e.queries(), e.oracle_sql(), []
    for name, fn in q.items():
        if pats and not any(name.startswith(p) for p in pats):
            continue
        try:
            msg, ok = compare(spark, con, sf, name, fn, o.get(name))
        except Exception as ex:  # noqa: BLE001
            msg, ok = f"FAIL {name}: {type(ex).__name__} {str(ex)[:700]}", False
        print(msg, flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
