"""Headers, example files, reports, saved models, the whole study and streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mistgrove.operators.describe import cores_table, tree_stats
from mistgrove.operators.encode import constant_features, drop_features, encode_examples
from mistgrove.operators.score import score_table
from mistgrove.plans.evaluation import fit_and_evaluate
from mistgrove.sources.examples import read_attributes, read_examples
from mistgrove.sources.models import load_model, save_model
from mistgrove.sources.reports import write_accuracy, write_confusion, write_model_summary
from mistgrove.streaming.scoring import score_stream

HEADER = """@relation weather
@attribute Temp real[-10.0,40.0]
@attribute Wind-dir{north, east,south}
@attribute Gusts integer [0,100]
@attribute Station {only}
@attribute Class{calm,storm}
@inputs Temp,Wind-dir,Gusts,Station
@outputs Class
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("weather")
    draw = random.Random(4)
    lines = []
    for _ in range(400):
        gusts = draw.randrange(101)
        stormy = gusts > 60
        lines.append(f"{draw.uniform(-10, 40):.3f},{draw.choice(['north', 'east', 'south'])},{gusts},only,{'storm' if stormy else 'calm'}")
    (folder / "weather.header").write_text(HEADER)
    (folder / "weather.data").write_text("\n".join(lines) + "\n")
    return folder


def test_header(spark, files):
    rows = read_attributes(spark, str(files / "weather.header")).orderBy("idx").collect()
    assert [(r.idx, r.name, r.kind) for r in rows] == [
        (0, "Temp", "numeric"), (1, "Wind-dir", "nominal"), (2, "Gusts", "numeric"), (3, "Station", "nominal"), (4, "Class", "nominal")
    ]
    assert (rows[0].lo, rows[0].hi, rows[2].lo, rows[2].hi) == (-10.0, 40.0, 0.0, 100.0)
    assert rows[1]["values"] == ["north", "east", "south"]
    assert [r.is_class for r in rows] == [False] * 4 + [True]


def test_bad_headers(spark, tmp_path):
    (tmp_path / "a").write_text("@attribute x real\n@outputs x\n")
    with pytest.raises(ValueError, match="cannot be parsed"):
        read_attributes(spark, str(tmp_path / "a"))
    (tmp_path / "b").write_text("@attribute x real[0,1]\n")
    with pytest.raises(ValueError, match="outputs"):
        read_attributes(spark, str(tmp_path / "b"))


def test_encoding(spark, files):
    attributes = read_attributes(spark, str(files / "weather.header"))
    df = read_examples(spark, str(files / "weather.data"), attributes)
    assert df.count() == 400 and dict(df.dtypes)["Gusts"] == "double"
    coded = encode_examples(df, attributes)
    assert {r[0] for r in coded.select("Wind-dir").distinct().collect()} == {0, 1, 2}
    odd = spark.createDataFrame([(1.0, "west", 1.0, "only", "snow")], df.schema)
    assert encode_examples(odd, attributes).first().asDict() == {"Temp": 1.0, "Wind-dir": -1, "Gusts": 1.0, "Station": 0, "Class": -1}
    kept, rest = drop_features(coded, attributes, constant_features(attributes))
    assert "Station" not in kept.columns
    assert [(r.idx, r.name) for r in rest.orderBy("idx").collect()] == [(0, "Temp"), (1, "Wind-dir"), (2, "Gusts"), (3, "Class")]


@pytest.mark.parametrize("binary, supervised", [(False, False), (True, False), (False, True)])
def test_study(spark, files, tmp_path, binary, supervised):
    attributes = read_attributes(spark, str(files / "weather.header"))
    df = read_examples(spark, str(files / "weather.data"), attributes)
    study = fit_and_evaluate(df, df, attributes, sets=5, max_depth=3, binary=binary, supervised=supervised)
    assert study.accuracy.first().accuracy > 0.9
    assert study.error.first().error_rate == pytest.approx(1 - study.accuracy.first().accuracy)
    assert study.tree.first().leaves > 1

    write_confusion(study.confusion, 2, f"{tmp_path}/confusion")
    text = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/confusion").collect()]
    assert sum(int(v) for row in text for v in row) == 400 and len(text) == 2
    write_accuracy(study.confusion, f"{tmp_path}/accuracy")
    assert {r.value.split(" = ")[0] for r in spark.read.text(f"{tmp_path}/accuracy").collect()} == {
        "Accuracy rate", "Geometric mean", "Avg. accuracy per class"
    }
    write_model_summary(study.cores, study.model, f"{tmp_path}/summary")
    summary = dict(r.value.split(": ") for r in spark.read.text(f"{tmp_path}/summary").collect())
    assert float(summary["Leaves"]) == study.tree.first().leaves
    if not supervised:
        assert float(summary["Fuzzy sets"]) == 10


def trained(spark, files):
    attributes = read_attributes(spark, str(files / "weather.header"))
    df = read_examples(spark, str(files / "weather.data"), attributes)
    model = fit_and_evaluate(df, df, attributes, max_depth=2, binary=True).model
    return encode_examples(df, attributes).withColumns({"Temp": F.lit(0.5), "Gusts": F.col("Gusts") / 100}), model


def test_saved_model_scores_the_same(spark, files, tmp_path):
    df, model = trained(spark, files)
    save_model(model, str(tmp_path / "model"))
    loaded = load_model(spark, str(tmp_path / "model"))
    assert loaded.features == model.features and tree_stats(loaded).first() == tree_stats(model).first()
    key = ["Gusts", "Wind-dir"]
    a, b = (sorted(map(tuple, score_table(df, m, key).select(*key, "prediction").collect())) for m in (model, loaded))
    assert a == b
    assert cores_table(model.features, spark).count() == 2


def test_stream_scores_like_a_table(spark, files, tmp_path):
    df, model = trained(spark, files)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    scored = score_stream(stream, model, ["Gusts", "Wind-dir"])
    run = scored.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True
    ).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("Gusts", "Wind-dir", "prediction").collect()))
    want = sorted(map(tuple, score_table(df, model, ["Gusts", "Wind-dir"]).drop("scores").collect()))
    assert got == want and len(got) == 400
