"""From raw columns to model inputs: nominal codes, constant columns, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mistgrove.features import Feature, reindex


def code_of(column: Column, values: list[str]) -> Column:
    """0-based position of a value in its declared list, -1 when it is not in it."""
    declared = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.array_position(declared, column.cast("string")) - 1, F.lit(-1)).cast("int")


def encode_examples(df: DataFrame, attributes: DataFrame) -> DataFrame:
    """Replace every nominal column, the class included, by its code.

    `attributes` has one row per column (idx, name, kind, lo, hi, values), so it is read here.
    """
    declared = {r.name: list(r["values"]) for r in attributes.filter("kind = 'nominal'").collect()}
    return df.withColumns({n: code_of(F.col(n), v) for n, v in declared.items() if n in df.columns})


def constant_features(attributes: DataFrame) -> DataFrame:
    """Nominal columns with fewer than two declared values: they cannot split anything."""
    return attributes.filter((F.col("kind") == "nominal") & (F.size("values") < 2))


def drop_features(df: DataFrame, attributes: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the named columns from the data and renumber the remaining attributes densely."""
    names = [r.name for r in dropped.select("name").collect()]
    return df.drop(*names), reindex(attributes.filter(~F.col("name").isin(names)))


def violations(df: DataFrame, features: list[Feature], label: str, classes: int) -> DataFrame:
    """One row (rows, rule, bad) per rule, all counted in a single pass over the `rows` rows.

    Rules: numeric null or NaN, nominal code outside 0..arity-1, label outside 0..classes-1.
    """
    rules = {}
    for f in features:
        x = F.col(f.name)
        if f.kind == "numeric":
            rules[f"{f.name}: null or NaN"] = x.isNull() | F.isnan(x.cast("double"))
        else:
            rules[f"{f.name}: code outside 0..{f.arity - 1}"] = x.isNull() | (x < 0) | (x >= f.arity)
    y = F.col(label)
    rules[f"{label}: class outside 0..{classes - 1}"] = y.isNull() | (y < 0) | (y >= classes)
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(rules.values())])
    named = [F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("bad")) for i, rule in enumerate(rules)]
    return counted.select("rows", F.inline(F.array(*named)))


def validate(df: DataFrame, features: list[Feature], label: str, classes: int) -> int:
    """Raise on empty input, missing columns or any violated rule; else the number of rows."""
    missing = [c for c in [*(f.name for f in features), label] if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the input: {missing}")
    found = violations(df, features, label, classes).collect()
    rows = found[0]["rows"]
    if rows == 0:
        raise ValueError("the input is empty")
    bad = [f"{r.rule}: {r.bad} rows" for r in found if r.bad]
    if bad:
        raise ValueError("invalid input: " + "; ".join(bad))
    return rows


def check_bins(features: list[Feature], max_bins: int, rows: int, binary: bool) -> int:
    """The usable number of bins, after checking that every column fits in it."""
    usable = min(max_bins, rows)
    for f in features:
        if (binary or f.kind == "nominal") and f.bins > usable:
            raise ValueError(f"{f.name} has {f.bins} bins, more than the {usable} allowed")
        if binary and f.bins < 2:
            raise ValueError(f"{f.name} has a single bin: drop it first")
    return usable
