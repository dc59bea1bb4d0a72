import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_come_from_the_catalog_whether_or_not_llm_is_there():
    from recollect.plans import catalog

    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")
def test_entry(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")
def test_catalog_against_sql(spark):
    """Every query of the catalog with SQL gives the rows that DuckDB gives."""
    import duckdb

    from recollect.plans import catalog

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    wrong = []
    for name, sql in catalog.ORACLE_SQL.items():
        got = catalog.QUERIES[name](spark, SMALL)
        columns = sorted(got.columns)
        ours = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
        theirs = con.sql(sql)
        at = [theirs.columns.index(c) for c in columns]
        if ours != sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall()):
            wrong.append(name)
    assert wrong == []
