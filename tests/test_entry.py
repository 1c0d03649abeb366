"""Registered queries against their DuckDB statements on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
# the search queries share one plan; run the widest of them
SHARED = {
    "batch_prefilter_top50",
    "unknown_origin_unfiltered",
    "category_semi_join",
    "date_list_filter",
    "date_range_filter",
    "price_filters",
    "semantic_threshold",
    "semantic_fallback_top10",
    "search_results",
    "search_debug",
    "left_out_rows",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


OWN = set(entry.queries()) - set(entry.LLM_QUERIES)


def test_every_query_has_a_statement():
    assert OWN == set(entry.oracle_sql()) - set(entry.LLM_ORACLES)


@pytest.mark.parametrize("name", sorted(OWN - SHARED))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.collect(), df.columns) == _rows(cursor.fetchall(), columns)
