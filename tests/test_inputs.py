"""What enters is checked; odd rows are scored alike however many stages the tree takes."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from mistgrove import nominal, numeric
from mistgrove.operators.cuts import subsample
from mistgrove.operators.scale import exact_quantiles
from mistgrove.operators.score import runs, score_table
from mistgrove.plans.evaluation import fit_and_evaluate
from mistgrove.plans.partitioning import fuzzy_partition
from mistgrove.plans.trees import train_binary, train_multi
from mistgrove.sources.examples import read_attributes, read_examples

FEATURES = [numeric("f0", [0.0, 25.0, 50.0, 75.0, 100.0]), nominal("f1", 3)]
ATTRIBUTES = "idx int, name string, kind string, lo double, hi double, values array<string>, is_class boolean"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([((i * 7) % 3, float(i % 101), i % 3) for i in range(600)], "label int, f0 double, f1 int") \
        .withColumn("label", F.when(F.col("f0") > 60, 2).otherwise(F.col("f1") % 2))


@pytest.mark.parametrize("binary", [False, True])
def test_odd_rows_score_alike_in_any_number_of_stages(spark, rows, binary):
    model = (train_binary if binary else train_multi)(rows, FEATURES, "label", 3, max_depth=4 if binary else 2)
    odd = spark.createDataFrame(
        [(1, 10.0, 0), (1, 10.0, 0), (2, 70.0, 1), (None, 70.0, 1), (3, None, 1), (4, math.nan, 2), (5, 30.0, 9), (6, 30.0, None)],
        "id int, f0 double, f1 int")
    whole = sorted(map(str, score_table(odd, model, ["id", "f0", "f1"]).collect()))
    for nodes in (1, 2, 5):
        assert len(runs(model, nodes)) > 1
        assert sorted(map(str, score_table(odd, model, ["id", "f0", "f1"], stage_nodes=nodes).collect())) == whole
    scored = score_table(odd, model, ["id"]).collect()
    assert len(scored) == 8
    if not binary:  # a value in no set reaches no leaf of a multi-way tree that asks for its column
        root = model.nodes.where("node_id = 1").first().split_feature
        assert {r.id: r.prediction for r in scored}[3 if root == 0 else 5] == -1


@pytest.mark.parametrize("value", [None, math.nan])
def test_missing_numbers_are_refused(spark, rows, value):
    spoilt = rows.union(spark.createDataFrame([(0, value, 1)], rows.schema))
    with pytest.raises(ValueError, match="f0: 1 rows"):
        exact_quantiles(spoilt, ["f0"], 10)
    with pytest.raises(ValueError, match="f0: null or NaN: 1 rows"):
        fuzzy_partition(spoilt, ["f0"], "label", 3, max_bins=20)
    with pytest.raises(ValueError, match="f0: null or NaN: 1 rows"):
        train_multi(spoilt, FEATURES, "label", 3)


@pytest.mark.parametrize("label", [None, 7])
def test_undeclared_classes_are_refused(spark, rows, label):
    spoilt = rows.union(spark.createDataFrame([(label, 1.0, 1)], rows.schema))
    with pytest.raises(ValueError, match="label: class outside 0..2: 1 rows"):
        fuzzy_partition(spoilt, ["f0"], "label", 3, max_bins=20)


def test_headers_and_files_are_refused(spark, tmp_path):
    header = tmp_path / "a.header"
    header.write_text("@attribute x real[0,1]\n@attribute c{p,q}\n@outputs z\n")
    with pytest.raises(ValueError, match="no @attribute"):
        read_attributes(spark, str(header))
    header.write_text("@attribute x real[0,1]\n@attribute c{p,q}\n@outputs x\n")
    with pytest.raises(ValueError, match="must be nominal"):
        read_attributes(spark, str(header))
    header.write_text("@attribute x real[0,1]\n@attribute c{p,q}\n@outputs c\n")
    (tmp_path / "a.data").write_text("0.5,p\nzero,q\n")
    with pytest.raises(Exception, match="MALFORMED|zero"):
        read_examples(spark, str(tmp_path / "a.data"), read_attributes(spark, str(header))).collect()


def test_study_of_nominal_columns_with_rows_kept_apart(spark, rows):
    attributes = spark.createDataFrame(
        [(0, "f1", "nominal", None, None, ["0", "1", "2"], False), (1, "label", "nominal", None, None, ["0", "1", "2"], True)], ATTRIBUTES)
    told = rows.select(F.col("f1").cast("string").alias("f1"), F.col("label").cast("string").alias("label"), "f0")
    study = fit_and_evaluate(told.where("f0 < 50"), told.where("f0 >= 50"), attributes, max_depth=1)
    assert study.cores.count() == 0
    assert study.scored.count() == told.where("f0 >= 50").count()


def test_sample_does_not_depend_on_layout(rows):
    one = sorted(map(str, subsample(rows, 0.4, key=["f0", "f1"]).collect()))
    assert one == sorted(map(str, subsample(rows.repartition(7), 0.4, key=["f0", "f1"]).collect()))
    assert 0.2 * 600 < len(one) < 0.6 * 600
