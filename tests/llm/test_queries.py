"""The registered queries against their SQL, and on empty tables."""

from __future__ import annotations

import duckdb
import pytest
from check_oracle import compare

from mistgrove.llm.oracle import ORACLE
from mistgrove.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    ok, note = compare(spark, con, name, QUERIES[name], ORACLE[name], FOLDER)
    assert ok, note


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for table in TABLES:
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


def test_without_labels_or_languages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None, "lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    scores = QUERIES["op3_toxicity"](spark, str(tmp_path)).collect()
    assert len(scores) == docs.count() and {(r["score"], r["predicted"]) for r in scores} == {(0.5, 0)}
    told = QUERIES["op9_language"](spark, str(tmp_path)).collect()
    assert len(told) == docs.count() and {(r["lang_pred"], r["score"]) for r in told} == {("und", 0.0)}
