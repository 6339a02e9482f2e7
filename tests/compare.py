"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, float)):
        return float(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf):
    """None when equal, else a description of the difference."""
    t = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    compare.spark_seconds = time.time() - t
    if sql is None:
        return None, len(got)
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} vs {sorted(rel.columns)}", len(got)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    alias = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c, t in zip(rel.columns, rel.types):
        if kinds[c] in alias and str(t) != alias[kinds[c]]:
            return f"type of {c}: {kinds[c]} vs {t}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, columns {sorted(df.columns)}, first {bad[0]}", len(got)
    return None, len(got)


compare.spark_seconds = 0.0


def main(argv):
    sf = f"/root/testdata/sf{argv[1]}"
    import __spark_entry__ as entry
    from eventloom.session import build_session

    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    mods = set(argv[2:])
    names = [n for n in queries if not mods or queries[n].__module__.rsplit(".", 1)[-1] in mods or any(a in n for a in mods)]
    failed = []
    for n in names:
        t = time.time()
        try:
            err, count = compare(spark, con, queries[n], sqls.get(n), sf)
        except Exception as e:  # report and go on
            err, count = f"{type(e).__name__}: {str(e)[:1500]}", -1
        mark = "ok  " if err is None else "FAIL"
        kind = "sql" if n in sqls else "rows"
        print(f"{mark} {kind} {n} rows={count} {time.time() - t:.2f}s (spark {compare.spark_seconds:.2f}s)" + ("" if err is None else f"\n     {err}"), flush=True)
        if err:
            failed.append(n)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv)
