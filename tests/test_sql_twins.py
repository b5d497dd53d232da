"""Every query against its SQL twin on the supplied tables."""

import os

import duckdb
import pytest

from tickerloom.catalog import all_queries, all_sql

SF_DIR = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'").fetchall()
    return con


def by_name(names, records):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in records), key=repr)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("key", sorted(all_queries()))
def test_same_rows(spark, duck, key):
    df = all_queries()[key](spark, SF_DIR)
    found = by_name(df.columns, df.collect())
    cursor = duck.execute(all_sql()[key])
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    assert found == by_name(names, cursor.fetchall())
    assert {n: TYPES[t] for n, t in df.dtypes} == kinds
