"""Sizes and readable forms of partitions and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistgrove.features import Feature
from mistgrove.functions.impurity import array_total
from mistgrove.plans.trees import TreeModel


def cores_table(features: list[Feature], spark) -> DataFrame:
    """(feature, cores) of the numeric columns of a feature list."""
    rows = [(f.name, list(f.cores)) for f in features if f.kind == "numeric"]
    return spark.createDataFrame(rows, "feature string, cores array<double>")


def partition_stats(cores: DataFrame) -> DataFrame:
    """One row of partition sizes; columns without cores count as discarded and in the average."""
    sized = cores.select("feature", F.size("cores").alias("sets"))
    kept = F.col("sets") > 0
    return sized.agg(
        F.sum("sets").cast("bigint").alias("total_sets"),
        F.avg("sets").alias("average_sets"),
        F.count_if(~kept).alias("discarded"),
        F.min_by("feature", F.struct((-F.col("sets")).alias("s"), "feature")).alias("most_feature"),
        F.max("sets").alias("most_sets"),
        F.min_by(F.when(kept, F.col("feature")), F.when(kept, F.struct("sets", "feature"))).alias("fewest_feature"),
        F.min(F.when(kept, F.col("sets"))).alias("fewest_sets"),
    )


def partition_listing(cores: DataFrame) -> DataFrame:
    """(feature, listing): the cores of each column as text, in order."""
    texts = F.transform(F.sort_array("cores"), lambda c: c.cast("string"))
    return cores.select("feature", F.array_join(texts, ", ").alias("listing"))


def tree_stats(model: TreeModel) -> DataFrame:
    """One row (nodes, leaves, max_depth, min_depth, avg_depth).

    Empty nodes of a multi-way tree count neither as nodes nor as leaves nor in the average,
    but they do in the extremes of the depth. A binary tree counts all its nodes.
    """
    filled = array_total(F.col("freq")) > 0
    counted = filled if model.kind == "multi" else F.lit(True)
    leaf = F.col("is_leaf")
    return model.nodes.agg(
        F.count_if(counted | (F.col("level") == 0)).alias("nodes"),
        F.count_if(leaf & filled).alias("leaves"),
        F.max("level").alias("max_depth"),
        F.min(F.when(leaf, F.col("level"))).alias("min_depth"),
        F.avg(F.when(leaf & counted, F.col("level"))).alias("avg_depth"),
    )


def tree_rules(model: TreeModel) -> DataFrame:
    """(node_id, rule, u, freq): one readable rule per leaf that holds rows."""
    names = F.array(*[F.lit(f.name) for f in model.features])

    def condition(step):
        bins = F.array_join(F.transform(F.array_sort(step["bins"]), lambda b: b.cast("string")), ",")
        if model.kind == "multi":
            return F.concat(F.get(names, step["feature"]), F.lit(" = "), bins)
        word = F.when(step["inside"], " in [").otherwise(" not in [")
        return F.concat(F.get(names, step["feature"]), word, bins, F.lit("]"))

    held = model.nodes.filter(F.col("is_leaf") & (array_total(F.col("freq")) > 0))
    return held.select(
        "node_id", F.array_join(F.transform("path", condition), " and ").alias("rule"), "u", "freq"
    )
