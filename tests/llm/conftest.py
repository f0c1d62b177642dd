import glob
import os

import duckdb
import pytest


@pytest.fixture(scope="session")
def docs(sf):
    """All documents as (doc_id, text)."""
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="session")
def frame(spark):
    """A small documents table with further columns."""
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)
    return make
