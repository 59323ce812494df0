"""Run a registered query and its SQL, and compare the rows without regard to order."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata"


def connection(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(map(plain, (r[i] for i in order))) for r in rows) if all(None not in r for r in rows) else sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = connection(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y
