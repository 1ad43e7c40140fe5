"""Every registered query against its SQL on the smallest tables; queries without SQL must give rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
import tablegraft.queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = tablegraft.queries.QUERIES, tablegraft.queries.ORACLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame, columns):
    text = frame[columns].astype(str).replace({"None": "NULL", "nan": "NULL", "<NA>": "NULL", "NaT": "NULL"})
    return text.sort_values(columns).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in SQL:
        assert len(got.columns) > 0
        return
    want = db.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert {c: str(got[c].dtype) for c in columns} == {c: str(want[c].dtype) for c in columns} or not len(want)
    assert rows(got, columns).equals(rows(want, columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())
