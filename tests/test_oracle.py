"""Every registered query with SQL, against DuckDB on the same Parquet tables."""

import harness
import pytest

import __spark_entry__ as entry

SF_DIR = f"{harness.DATA}/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return harness.database(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_spark_and_sql_agree(spark, database, name):
    assert harness.compare(QUERIES[name](spark, SF_DIR), database, SQL[name]) == []


def test_names_match():
    assert set(SQL) <= set(QUERIES)


def test_the_flagship_query_runs(spark):
    df = entry.entry(spark)
    assert {"segmento", "recall", "hit_rate"} <= set(df.columns)
    assert df.count() > 1
