"""The whole study: scale, partition, train, score and evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from mistgrove.features import Feature, nominal, numeric
from mistgrove.operators.bins import uniform_cores
from mistgrove.operators.describe import cores_table, tree_stats
from mistgrove.operators.encode import constant_features, drop_features, encode_examples
from mistgrove.operators.evaluate import accuracy_stats, confusion_matrix, error_rate
from mistgrove.operators.scale import exact_quantiles, quantile_lists, to_uniform
from mistgrove.operators.score import score_table
from mistgrove.plans.partitioning import fuzzy_partition
from mistgrove.plans.trees import TreeModel, train_binary, train_multi


@dataclass(frozen=True)
class Study:
    """Everything a fit-and-evaluate run yields; every member is a table or a model."""

    model: TreeModel
    cores: DataFrame
    scored: DataFrame
    confusion: DataFrame
    accuracy: DataFrame
    error: DataFrame
    tree: DataFrame


def fit_and_evaluate(
    train: DataFrame, test: DataFrame, attributes: DataFrame, sets: int = 5, max_depth: int = 5,
    binary: bool = False, tnorm: str = "product", supervised: bool = False, bins: int = 1000,
    keep: list[str] | None = None, **options,
) -> Study:
    """Train on one table and evaluate on another, as described by `attributes`.

    Numeric columns are mapped to a uniform distribution by the quantiles of the training rows
    and get `sets` evenly spaced fuzzy sets, or with `supervised` the cores of an entropy search
    (columns it discards are left out). Constant nominals are dropped. The bin limit grows to
    the largest arity.
    """
    spark = train.sparkSession
    rows = attributes.orderBy("idx").collect()
    label = next((r for r in rows if r.is_class), None)
    if label is None or label.kind != "nominal":
        raise ValueError("the attributes need one nominal class")
    inputs = attributes.filter("not is_class")
    lower = {r.name: r.lo for r in rows if r.kind == "numeric" and not r.is_class}
    quantiles = quantile_lists(exact_quantiles(train, list(lower), bins))

    def prepared(df: DataFrame) -> DataFrame:
        encoded = encode_examples(to_uniform(df, quantiles, lower), attributes)
        return drop_features(encoded, inputs, constant_features(inputs))[0]

    fit = prepared(train)
    classes = len(label["values"])
    if supervised and lower:
        cores = fuzzy_partition(fit, list(lower), label.name, classes)
        found = {r.feature: r.cores for r in cores.collect()}
    else:
        found = {c: uniform_cores(sets) for c in lower}
        cores = cores_table([numeric(c, v) for c, v in found.items()], spark)
    features: list[Feature] = []
    for r in rows:
        if r.is_class:
            continue
        if r.kind == "numeric" and len(found[r.name]) > 1:
            features.append(numeric(r.name, found[r.name]))
        elif r.kind == "nominal" and len(r["values"]) > 1:
            features.append(nominal(r.name, len(r["values"])))
    options.setdefault("max_bins", max([32, *(f.arity for f in features)]))
    grow = train_binary if binary else train_multi
    model = grow(fit, features, label.name, classes, tnorm, max_depth, **options)
    scored = score_table(prepared(test), model, [*(keep or []), label.name])
    matrix = confusion_matrix(scored, classes, label.name)
    return Study(
        model, cores, scored, matrix, accuracy_stats(matrix), error_rate(scored, label.name), tree_stats(model)
    )
