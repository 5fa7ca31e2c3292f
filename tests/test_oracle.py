"""Every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from pageloom.plans.oracle import ORACLE
from pageloom.plans.queries import QUERIES

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((value is None, str(value)) for value in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, database, name):
    result = QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    found = ordered(tuple(row[column] for column in columns) for row in result.collect())
    assert found
    cursor = database.execute(ORACLE[name])
    names = [column[0] for column in cursor.description]
    types = {column[0]: str(column[1]) for column in cursor.description}
    assert sorted(names) == columns
    assert {c: TYPES[t] for c, t in result.dtypes} == types
    places = [names.index(column) for column in columns]
    expected = ordered(tuple(row[place] for place in places) for row in cursor.fetchall())
    assert found == expected


def test_entry_runs(spark):
    result = entry.entry(spark)
    assert result.columns == ["TITLE", "URL", "QUANTITY"]
    assert result.count() > 0


@pytest.mark.parametrize(
    "name, column",
    [
        ("words_of_page", "id_page"),
        ("word_percentages_of_page", "id_page"),
        ("shared_bigrams_of_page", "id_page1"),
        ("shared_trigrams_of_page", "id_page1"),
    ],
)
def test_page_lookups_prune_their_scan(spark, sf_dir, name, column):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any(f"EqualTo({column}," in line or f"In({column}," in line for line in pushed)


def test_queries_are_shipped_to_the_workers(spark, sf_dir):
    prepared = entry.queries()
    assert set(QUERIES) <= set(prepared)
    assert prepared["page_text"](spark, sf_dir).count() > 0
