"""Trained trees as plain Parquet tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from mistgrove.features import features_from_table, features_table
from mistgrove.plans.trees import TreeModel


def save_model(model: TreeModel, path: str) -> None:
    """Write the nodes, the features and the settings of a tree below `path`."""
    spark = model.nodes.sparkSession
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    features_table(spark, model.features).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
    settings = [(model.kind, model.classes, model.tnorm)]
    spark.createDataFrame(settings, "kind string, classes int, tnorm string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> TreeModel:
    """Read a tree written by `save_model`."""
    settings = spark.read.parquet(f"{path}/settings").first()
    features = features_from_table(spark.read.parquet(f"{path}/features"))
    nodes = spark.read.parquet(f"{path}/nodes")
    return TreeModel(settings.kind, nodes, features, settings.classes, settings.tnorm)
