"""The queries of Parquet structure over tables of several files, against their own SQL asked of each file."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest
from oracle import DATA, rows_of

from framekit.plans import queries as core

TABLES = ("orders", "embeddings")
PARTS = 3


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Tables that are folders; the names of their files say nothing of the table, and some have two row groups."""
    d = str(tmp_path_factory.mktemp("parts"))
    for name in TABLES:
        whole = pq.read_table(f"{DATA}/sf0.001/{name}.parquet")
        os.makedirs(f"{d}/{name}.parquet")
        step = -(-whole.num_rows // PARTS)
        for i in range(PARTS):
            pq.write_table(whole.slice(i * step, step), part(d, name, i), row_group_size=400)
    return d


def part(d, name, i):
    return f"{d}/{name}.parquet/part-{i:04d}-c000.snappy.parquet"


def asked_of_each_file(sql, d):
    """The SQL's columns and rows, where the i-th files stand for the tables and for those that it looks through."""
    names, rows = [], []
    for i in range(PARTS):
        con, text = duckdb.connect(), sql
        files = {name: part(d, name, i) for name in TABLES}
        for name, path in files.items():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
            text = text.replace(f"'{DATA}/sf*/{name}.parquet'", f"'{path}'")
        cur = con.execute(text.replace(f"'{DATA}/sf*/*.parquet'", str(list(files.values()))))
        names, rows = [c[0] for c in cur.description], rows + cur.fetchall()
    return names, rows


def test_partitions_of_tables_of_several_files(spark, folder):
    df = core.queries()["parquet_partitions"](spark, folder)
    names, rows = asked_of_each_file(core.oracle_sql()["parquet_partitions"], folder)
    want = {}
    for r in rows:
        r = dict(zip(names, r, strict=True))
        of = want.setdefault(r.pop("name"), dict.fromkeys(r, 0))
        of.update({k: of[k] + v for k, v in r.items()})
    assert sorted(df.columns) == sorted(names)
    assert {r.pop("name"): r for r in (x.asDict() for x in df.collect())} == want and set(want) == set(TABLES)


@pytest.mark.parametrize("name", ["parquet_schema", "parquet_metadata", "parquet_blocks", "parquet_block_columns"])
def test_each_file_of_a_table(spark, folder, name):
    df = core.queries()[name](spark, folder)
    names, rows = asked_of_each_file(core.oracle_sql()[name], folder)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, rows) and rows
