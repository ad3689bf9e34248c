"""Triangular and singleton fuzzy sets, and the two t-norms, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_support(x: Column, a: Column, c: Column) -> Column:
    """Whether `x` lies strictly between `a` and `c`; a null end is open."""
    return ~F.isnan(x) & (a.isNull() | (x > a)) & (c.isNull() | (x < c))


def triangular_membership(x: Column, a: Column, b: Column, c: Column) -> Column:
    """Membership of `x` in the triangle (a, b, c); on the side of a null end it is 1."""
    rising = F.when(a.isNull(), 1.0).otherwise((x - a) / (b - a))
    falling = F.when(c.isNull(), 1.0).otherwise(1.0 - (x - b) / (c - b))
    return F.when(in_support(x, a, c), F.when(x <= b, rising).otherwise(falling)).otherwise(0.0)


def singleton_support(x: Column, v: Column) -> Column:
    """Whether `x` is the singleton's value."""
    return x == v


def singleton_membership(x: Column, v: Column) -> Column:
    """1 where `x` is the singleton's value, else 0."""
    return singleton_support(x, v).cast("double")


def triangular_set(p: Column, q: Column, r: Column) -> Column:
    """One triangle from three parameters in any order, as struct<a, b, c>."""
    ordered = F.sort_array(F.array(p, q, r))
    return F.struct(
        F.get(ordered, 0).alias("a"), F.get(ordered, 1).alias("b"), F.get(ordered, 2).alias("c")
    )


def triangular_partition(cores: DataFrame, keys: tuple[str, ...] = ("feature",), core: str = "core") -> DataFrame:
    """Triangles over each key's distinct cores: neighbours are the feet, outer feet are null (open)."""
    order = Window.partitionBy(*keys).orderBy(core)
    return cores.select(*keys, core).distinct().select(
        *keys,
        (F.row_number().over(order) - 1).alias("bin"),
        F.lag(core).over(order).alias("a"),
        F.col(core).alias("b"),
        F.lead(core).over(order).alias("c"),
    )


def singleton_partition(arities: DataFrame, keys: tuple[str, ...] = ("feature",), arity: str = "arity") -> DataFrame:
    """One singleton per code of each nominal column."""
    codes = F.explode(F.sequence(F.lit(0), F.col(arity) - 1)).alias("bin")
    return arities.select(*keys, codes).withColumn("v", F.col("bin").cast("double"))


def tnorm_product(*degrees: Column) -> Column:
    """Product of the degrees, 1 for none."""
    return reduce(lambda x, y: x * y, degrees) if degrees else F.lit(1.0)


def tnorm_min(*degrees: Column) -> Column:
    """Least of the degrees and 1."""
    return F.least(F.lit(1.0), *degrees) if degrees else F.lit(1.0)


def tnorm(name: str):
    """The t-norm of that name, in any case."""
    known = {"product": tnorm_product, "min": tnorm_min}
    if name.lower() not in known:
        raise ValueError(f"unknown t-norm {name!r}: use one of {sorted(known)}")
    return known[name.lower()]
