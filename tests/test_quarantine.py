"""Rejected lines of example files, and the confusion matrix of a stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mistgrove.operators.evaluate import confusion_matrix
from mistgrove.sources.examples import read_attributes, sift_examples
from mistgrove.streaming.scoring import confusion_stream

HEADER = "@relation r\n@attribute a real [0, 10]\n@attribute b integer [0, 5]\n@attribute c {x, y}\n@inputs a, b\n@outputs c\n@data\n"


@pytest.fixture
def sifted(spark, tmp_path):
    def of(text: str):
        header, data = tmp_path / "h.header", tmp_path / "rows"
        data.mkdir()
        header.write_text(HEADER)
        (data / "one.data").write_text(text)
        return sift_examples(spark, str(data), read_attributes(spark, str(header)))

    return of


def test_bad_lines_are_kept_with_their_reason(sifted):
    good, bad = sifted("1.5, 2, x\n1,2\nq,2,y\n3,2,y,9\n,1,x\n2,zz,x\n\n4,5,new\n1.5, 2, x\n")
    assert sorted(map(tuple, good.collect()), key=str) == sorted([(1.5, 2.0, "x"), (None, 1.0, "x"), (4.0, 5.0, "new"), (1.5, 2.0, "x")], key=str)
    assert {(r.line, r.reason) for r in bad.collect()} == {
        ("1,2", "2 fields instead of 3"), ("q,2,y", "a: not a number"),
        ("3,2,y,9", "4 fields instead of 3"), ("2,zz,x", "b: not a number")}
    assert all(r.file.endswith("one.data") for r in bad.collect())
    assert good.schema.simpleString() == "struct<a:double,b:double,c:string>"


def test_empty_files_give_two_empty_tables(sifted):
    good, bad = sifted("")
    assert good.count() == bad.count() == 0 and bad.columns == ["file", "line", "reason"]


def test_stream_matrix_ends_as_the_batch_one(spark, tmp_path):
    rows = spark.range(900).select((F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 7 - 1).cast("int").alias("prediction"))
    folder = str(tmp_path / "scored")
    rows.repartition(6).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    query = confusion_stream(stream, 3).writeStream.outputMode("complete").format("memory").queryName("matrix") \
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert len(query.recentProgress) >= 3
    found = {(r.label, r.prediction): r.n for r in spark.table("matrix").collect()}
    wanted = {(r.label, r.prediction): r.n for r in confusion_matrix(rows, 3).collect()}
    assert found == {k: n for k, n in wanted.items() if n}
