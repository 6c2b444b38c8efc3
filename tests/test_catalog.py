"""Every named query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from symbolith.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, int, float)):
        return round(float(v), 6)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def made(spark, folder, texts, table="documents"):
    """A folder with a table of these texts, and DuckDB's view of it."""
    data = [(k, t, f"src{k % 2}") for k, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return c


def test_autofix_leaves_longer_names_spelt_like_the_first_word(spark, tmp_path):
    con = made(spark, tmp_path, ["words\nword\nwords\nwords", "word\nword\nother", "tests\nabc\ntests\ntest", ""])
    got, want = catalog.QUERIES["autofix"](spark, str(tmp_path)), con.sql(catalog.ORACLE["autofix"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0
