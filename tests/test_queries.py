"""The registered queries against their SQL equivalents, on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from workload.oracle import ORACLE
from workload.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = contract.FLAGSHIP_DATA
TABLES = ("orders", "lineitem", "part", "customer", "documents")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def rows_by_name(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize(
    "name", ["prepare", "prepare_stats", "consecutive_diff", "catalog_match", "report_document", "report_positions",
     "diff_document_positions", "snapshot_status", "csv_rows_by_snapshot", "registry_map_typed", "collect_status",
     "history_merge", "unmatched_checklist_positions", "catalog_files", "listing_files", "listing_files_status", "import_document_pretty"]
)
def test_same_as_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    expected = connection.execute(contract.oracle_sql()[name])
    columns = [column[0] for column in expected.description]
    df = contract.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert rows_by_name(df.collect(), df.columns) == rows_by_name(expected.fetchall(), columns)


def test_entry(spark):
    assert contract.entry(spark).limit(5).count() == 5
