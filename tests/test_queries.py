"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from check_oracle import TABLES, compare

import __spark_entry__ as entry
from mistgrove.catalog.oracle import ORACLE
from mistgrove.catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SLOW_TWINS = {  # same job as another query, or checked on its parts
    "tree_stats_binary", "accuracy_report", "confusion_report", "error_rate", "confusion_matrix", "model_summary",
    "partition_stats", "fit_and_evaluate_nodes", "multi_tree_nodes", "tree_stats", "tree_rules", "binary_tree_nodes",
}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW_TWINS))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLE[name], FOLDER)
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
