"""Run registered queries beside their SQL twins in DuckDB and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.plans.registry import TABLES  # noqa: E402


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(v[k])}" for k in sorted(v)) + "}"
    if hasattr(v, "asDict"):
        return cell(v.asDict())
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, root, build, sql):
    df = build(spark, root)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}", len(got)
    return "", len(got)


def main(argv):
    root = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    from __spark_entry__ import oracle_sql, queries

    from plumbline.session import local_session

    spark = local_session()
    if os.environ.get("SMALL_BYTES"):  # 0 forces the plans for large inputs
        spark.conf.set("spark.plumbline.smallBytes", os.environ["SMALL_BYTES"])
    con = connect(root)
    sqls, failed = oracle_sql(), []
    for name, build in queries().items():
        if argv and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        start = time.time()
        try:
            if name in sqls:
                msg, n = compare(spark, con, root, build, sqls[name])
            else:
                n, msg = len(build(spark, root).collect()), ""
        except Exception as e:  # report and go on with the next query
            msg, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        kind = "sql " if name in sqls else "rows"
        print(f"{'ok  ' if not msg else 'FAIL'} {kind} {name:38s} {n:7d} rows {time.time() - start:6.1f}s {msg}", flush=True)
        if msg or n == 0:
            failed.append(name)
    print("failed or empty:", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
