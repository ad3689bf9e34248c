"""Scoring rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistgrove.operators.bins import with_coords
from mistgrove.operators.score import predict_class, scores_in_place
from mistgrove.plans.trees import TreeModel


def score_stream(stream: DataFrame, model: TreeModel, keep: list[str]) -> DataFrame:
    """The kept columns, `scores` and `prediction` of a streaming table.

    Scoring looks at one row at a time, so it needs neither state nor a watermark.
    """
    scored = with_coords(stream, model.features, *keep).withColumn("scores", scores_in_place(model)("coords"))
    return scored.drop("coords").withColumn("prediction", predict_class(F.col("scores")))


def confusion_stream(scored: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """(label, prediction, n) of a stream of scored rows, as it grows; pairs appear with their first row.

    Write it in update mode (changed pairs) or complete mode (all of them). State is one count per pair of declared classes,
    whatever the length of the stream; rows whose label or prediction is none of them (-1, null) are left out, as in `confusion_matrix`.
    """
    pair = scored.select(F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))
    inside = F.col("label").between(0, classes - 1) & F.col("prediction").between(0, classes - 1)
    return pair.where(inside).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
