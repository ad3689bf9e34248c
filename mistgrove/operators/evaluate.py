"""Quality of a scored table: confusion matrix, accuracy measures, error rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(scored: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """(label, prediction, n) for all pairs of classes, zeros included; labels or predictions of -1 fall outside."""
    counts = scored.groupBy(F.col(label).cast("int").alias("label"), "prediction").agg(F.count("*").alias("n"))
    every = F.sequence(F.lit(0), F.lit(classes - 1))
    one = counts.sparkSession.range(1)
    grid = one.select(F.explode(every).alias("label")).select("label", F.explode(every).alias("prediction"))
    return grid.join(counts, ["label", "prediction"], "left").fillna(0, ["n"])


def accuracy_stats(matrix: DataFrame) -> DataFrame:
    """One row (accuracy, geometric_mean, mean_recall); a class without rows makes the means NaN."""
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    per_class = matrix.groupBy("label").agg(hits.alias("hits"), F.sum("n").alias("n")).withColumn(
        "recall", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(float("nan"))
    )
    gathered = per_class.agg(
        F.sum("hits").alias("hits"), F.sum("n").alias("n"), F.count("*").alias("k"),
        F.product("recall").alias("product"), F.avg("recall").alias("mean_recall"),
    )
    return gathered.select(
        F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(float("nan")).alias("accuracy"),
        F.pow("product", 1.0 / F.col("k")).alias("geometric_mean"), "mean_recall",
    )


def error_rate(scored: DataFrame, label: str = "label") -> DataFrame:
    """One row (error_rate): the share of rows predicted wrongly."""
    return scored.agg(F.avg((F.col(label) != F.col("prediction")).cast("double")).alias("error_rate"))
