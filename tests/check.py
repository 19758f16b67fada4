"""Compare registered queries with their SQL twins (same comparison as the tests use)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    return "NULL" if v is None else str(v)


def rows_of(table: pa.Table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(canon(v) for v in r) for r in zip(*cols))


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = df.toArrow()
    t1 = time.time()
    if sql is None:
        return f"rows={got.num_rows}", t1 - t0, 0.0
    want = con.execute(sql).to_arrow_table()
    t2 = time.time()
    gn, g = rows_of(got)
    wn, w = rows_of(want)
    if gn != wn:
        return f"FAIL columns {gn} != {wn}", t1 - t0, t2 - t1
    bad = [(f.name, str(f.type), str(want.schema.field(f.name).type)) for f in got.schema
           if (pa.types.is_floating(f.type) != pa.types.is_floating(want.schema.field(f.name).type))
           or pa.types.is_decimal(want.schema.field(f.name).type) or pa.types.is_nested(f.type)]
    if g != w:
        sg, sw = set(g), set(w)
        return (f"FAIL rows {len(g)} vs {len(w)}; only spark {list(sg - sw)[:2]} only sql {list(sw - sg)[:2]} {bad}"[:1500],
                t1 - t0, t2 - t1)
    return f"ok rows={len(g)}" + (f" TYPES {bad}" if bad else "") + ("" if g else " EMPTY"), t1 - t0, t2 - t1


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from pagewright.session import local_session

    folder = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.001")
    names = sys.argv[2:]
    spark = local_session(8)
    con = duck(folder)
    qs, sqls = entry.queries(), entry.oracle_sql()
    fails = 0
    for n, fn in qs.items():
        if names and not any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names):
            continue
        try:
            msg, a, b = compare(spark, con, folder, n, fn, sqls.get(n))
        except Exception as exc:  # report and go on with the next query
            msg, a, b = "ERROR " + str(exc)[:900], 0, 0
        fails += msg.startswith(("FAIL", "ERROR"))
        print(f"{n:28s} spark {a:6.2f}s sql {b:6.2f}s {msg}", flush=True)
    print("failures:", fails)
