"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from mentora.plans.catalogue import catalogue, catalogue_sql

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalogue_sql()))
def test_same_as_sql(spark, db, name):
    ours, theirs = catalogue()[name](spark, SF_DIR), db.sql(catalogue_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())
