"""Compares a query with its SQL on DuckDB, whatever the order of rows and columns."""

import datetime

import duckdb

from tessera.sources.tables import TABLES


def plain(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=lambda r: tuple(map(str, r)))


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        want = rows(names, cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(names)
    assert got == want
    return len(got)
