"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def ordered(names, rows):
    positions = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(row[i]) for i in positions) for row in rows)


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 200


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, database, name):
    frame = contract.queries()[name](spark, FOLDER)
    rows = frame.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = database.execute(sql)
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert ordered(frame.columns, rows) == ordered(names, cursor.fetchall())
