"""The queries that SQL can express, against their SQL."""

import os

import duckdb
import pytest

from tickerloom.llm.queries import QUERIES, SQL

SF_DIR = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_rows(spark, key):
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'").fetchall()
    df = QUERIES[key](spark, SF_DIR)
    cursor = con.execute(SQL[key])
    names = sorted(c[0] for c in cursor.description)
    at = {c[0]: i for i, c in enumerate(cursor.description)}
    want = sorted((tuple(r[at[n]] for n in names) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == want


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
