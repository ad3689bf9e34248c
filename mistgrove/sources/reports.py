"""Writers of evaluation results and model sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistgrove.operators.describe import partition_stats, tree_stats
from mistgrove.operators.evaluate import accuracy_stats
from mistgrove.plans.trees import TreeModel


def confusion_grid(matrix: DataFrame, classes: int) -> DataFrame:
    """One row per class with the counts of each prediction as columns p0, p1, ..."""
    cells = [F.sum(F.when(F.col("prediction") == j, F.col("n")).otherwise(0)).alias(f"p{j}") for j in range(classes)]
    return matrix.groupBy("label").agg(*cells)


def write_confusion(matrix: DataFrame, classes: int, path: str) -> None:
    """The classes x classes matrix as tab-separated text, in class order."""
    grid = confusion_grid(matrix, classes).coalesce(1).sortWithinPartitions("label").drop("label")
    grid.write.mode("overwrite").csv(path, sep="\t")


def accuracy_lines(matrix: DataFrame) -> DataFrame:
    """(measure, value) of the accuracy measures."""
    names = {"Accuracy rate": "accuracy", "Geometric mean": "geometric_mean", "Avg. accuracy per class": "mean_recall"}
    parts = [F.struct(F.lit(k).alias("measure"), F.col(v).alias("value")) for k, v in names.items()]
    return accuracy_stats(matrix).select(F.inline(F.array(*parts)))


def write_accuracy(matrix: DataFrame, path: str) -> None:
    """Accuracy, geometric mean and mean recall, one `name = value` line each."""
    line = F.concat_ws(" = ", "measure", F.col("value").cast("string")).alias("value")
    accuracy_lines(matrix).coalesce(1).select(line).write.mode("overwrite").text(path)


def model_summary(cores: DataFrame, model: TreeModel) -> DataFrame:
    """(measure, value): sizes of the partitions and of the tree."""
    parts = {
        "Fuzzy sets": "total_sets", "Fuzzy sets per numeric feature": "average_sets",
        "Discarded features": "discarded", "Most fuzzy sets of a feature": "most_sets",
        "Fewest fuzzy sets of a kept feature": "fewest_sets",
    }
    tree = {
        "Nodes": "nodes", "Leaves": "leaves", "Maximum depth": "max_depth", "Minimum depth": "min_depth",
        "Average depth": "avg_depth",
    }

    def lines(df: DataFrame, names: dict[str, str]) -> DataFrame:
        rows = [F.struct(F.lit(k).alias("measure"), F.col(v).cast("double").alias("value")) for k, v in names.items()]
        return df.select(F.inline(F.array(*rows)))

    return lines(partition_stats(cores), parts).unionByName(lines(tree_stats(model), tree))


def write_model_summary(cores: DataFrame, model: TreeModel, path: str) -> None:
    """The model summary as `name: value` lines."""
    line = F.concat_ws(": ", "measure", F.col("value").cast("string")).alias("value")
    model_summary(cores, model).coalesce(1).select(line).write.mode("overwrite").text(path)
