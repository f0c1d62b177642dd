import glob
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        return round(float(value), 9) + 0.0 if isinstance(value, (float, Decimal)) else value

    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in frame.collect()]
    if name not in ORACLE:
        assert rows
        return
    result = duck.execute(ORACLE[name])
    assert canonical(frame.columns, rows) == canonical([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(ORACLE) <= set(QUERIES)
