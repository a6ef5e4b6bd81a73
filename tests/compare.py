"""Runs registered queries beside their SQL and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def key(row) -> tuple:
    return tuple(plain(v) for v in row)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(key(r) for r in df.select(*columns).collect())


def duck_rows(con, sql: str):
    rel = con.sql(sql)
    names = list(rel.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(key([r[i] for i in order]) for r in rel.fetchall())


def compare(spark, sf_dir: str, name: str, query, sql: str | None) -> str:
    """Empty when equal, else what differs."""
    got_columns, got = spark_rows(query(spark, sf_dir))
    if sql is None:
        return ""
    want_columns, want = duck_rows(duck(sf_dir), sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        extra = [r for r in set(got) - set(want)][:3]
        missing = [r for r in set(want) - set(got)][:3]
        return f"{len(got)} rows, wanted {len(want)}; extra {extra}; missing {missing}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, sys.path[0] + "/..")
    import __spark_entry__ as entry
    from termloom.session import local_session

    spark = local_session(cores="8")
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            diff = compare(spark, sf, name, query, sqls.get(name))
        except Exception as e:
            diff = f"{type(e).__name__}: {e}"
        print(f"{'ok  ' if not diff else 'FAIL'} {name} {time.time() - start:.1f}s {diff[:700]}", flush=True)
