"""Fuzzification: which fuzzy sets or categories a row falls in, and how much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mistgrove.features import Feature
from mistgrove.functions.lookup import CASE_LIMIT, apart, constant, decide, double_array, let, rank_of

def uniform_cores(sets: int) -> list[float]:
    """`sets` evenly spaced cores on [0, 1]."""
    if sets < 2:
        raise ValueError("at least two fuzzy sets are needed")
    return [i * (1.0 / (sets - 1)) for i in range(sets)]


def uniform_cores_table(names: DataFrame, sets: int) -> DataFrame:
    """(feature, bin, core): the same evenly spaced cores for every listed numeric column."""
    uniform_cores(sets)
    place = F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("bin")
    return names.select("feature", place).withColumn("core", F.col("bin") * F.lit(1.0 / (sets - 1)))


def coordinate(feature: Feature) -> Column:
    """Where a value lies on its column's scale of bins, as one number.

    A numeric value between cores k and k+1 has k plus its share of the way: it belongs to bin k
    with one minus that share and to bin k+1 with the share. A category has its code. Outer
    values sit on the first or last core; a code that was not declared, a null and a NaN become -1:
    they belong to no set, so a multi-way tree gives them no leaf and a binary one the right-hand side.
    """
    x = F.col(feature.name)
    if feature.kind == "nominal":
        known = (x >= 0) & (x < feature.arity)
        return F.when(known, x).otherwise(-1).cast("double")
    x, cores = x.cast("double"), feature.cores
    none = x.isNull() | F.isnan(x)
    last = len(cores) - 1

    def leaf(passed: int) -> Column:
        k = passed - 1
        if k < 0 or k == last:
            return F.lit(float(max(k, 0)))
        return F.lit(float(k)) + (x - F.lit(cores[k])) / F.lit(cores[k + 1] - cores[k])

    if len(cores) <= CASE_LIMIT:
        return F.when(none, -1.0).otherwise(decide(x, cores, leaf, inclusive=True))
    table = double_array(cores)

    def between(k: Column) -> Column:
        b, c = F.get(table, k), F.get(table, k + 1)
        return F.when(k < 0, 0.0).when(k == last, float(last)).otherwise(k + (x - b) / (c - b))

    return F.when(none, -1.0).otherwise(let(rank_of(x, cores, inclusive=True) - 1, between))


def lower_bin(coord: Column) -> Column:
    """The lowest fired bin (-1 for an undeclared category)."""
    return F.floor(coord).cast("int")


def upper_degree(coord: Column) -> Column:
    """Membership in the bin above the lowest fired one, often 0; that one has the rest of 1."""
    return coord - F.floor(coord)


def with_coords(df: DataFrame, features: list[Feature], *keep) -> DataFrame:
    """The kept columns and `coords`, one coordinate per feature in feature order."""
    comparisons = sum(len(f.cores) + 2 for f in features)
    coords = apart(F.array(*[coordinate(f) for f in features]), comparisons)
    return df.select(*keep, coords.alias("coords"))


def fired(coord: Column) -> Column:
    """A coordinate as the array of its fired (bin, mu) pairs; empty for an undeclared category."""

    def pair(b: Column, mu: Column) -> Column:
        return F.struct(b.alias("bin"), mu.alias("mu"))

    b, up = lower_bin(coord), upper_degree(coord)
    none = F.array().cast("array<struct<bin:int,mu:double>>")
    return (
        F.when(coord < 0, none).when(up > 0, F.array(pair(b, 1.0 - up), pair(b + 1, up)))
        .otherwise(F.array(pair(b, F.lit(1.0))))
    )


def bin_features(df: DataFrame, features: list[Feature], *keep) -> DataFrame:
    """The kept columns and, per feature, an array of all fired (bin, mu) pairs."""
    binned = with_coords(df, features, *keep)
    kept = [c for c in binned.columns if c != "coords"]
    return binned.select(
        *kept, *[fired(F.get("coords", F.lit(i))).alias(f.name) for i, f in enumerate(features)]
    )


def sets_of(feature: Feature) -> Column:
    """The fuzzy sets of one column as a constant array of (bin, a, b, c), null feet open."""
    if feature.kind == "numeric":
        feet = [None, *feature.cores, None]
        rows = [dict(zip("abc", feet[k:k + 3]), bin=k) for k in range(len(feature.cores))]
    else:
        rows = [{"bin": k, "a": float(k), "b": float(k), "c": float(k)} for k in range(feature.arity)]
    return constant(rows, "array<struct<bin:int,a:double,b:double,c:double>>")


def partition_table(spark: SparkSession, features: list[Feature]) -> DataFrame:
    """(feature, bin, a, b, c) of every fuzzy set; null feet are open, a singleton has a = b = c."""
    parts = [F.struct(F.lit(f.name).alias("feature"), sets_of(f).alias("sets")) for f in features]
    opened = spark.range(1).select(F.inline(F.array(*parts)))
    return opened.select("feature", F.inline("sets"))
