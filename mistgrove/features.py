"""What a model knows about its input columns (schema-sized, so it lives on the driver)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEATURES_SCHEMA = "feature int, name string, kind string, cores array<double>, arity int"


@dataclass(frozen=True)
class Feature:
    """One input column: numeric with the cores of its fuzzy sets, or nominal with its arity."""

    name: str
    kind: str
    cores: tuple[float, ...] = ()
    arity: int = 0

    @property
    def bins(self) -> int:
        return len(self.cores) if self.kind == "numeric" else self.arity


def numeric(name: str, cores) -> Feature:
    """A numeric column. Equal cores are merged: two equal ones would leave a gap at their place."""
    distinct = tuple(sorted({float(c) for c in cores}))
    if len(distinct) < 2:
        raise ValueError(f"{name}: a triangular partition needs at least two distinct cores")
    return Feature(name, "numeric", cores=distinct)


def nominal(name: str, arity: int) -> Feature:
    """A nominal column holding the codes 0 .. arity-1."""
    return Feature(name, "nominal", arity=int(arity))


def features_table(spark: SparkSession, features: list[Feature]) -> DataFrame:
    """The feature list as a table, one row per input column."""
    rows = [(i, f.name, f.kind, list(f.cores) or None, f.arity or None) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, FEATURES_SCHEMA)


def features_from_table(table: DataFrame) -> list[Feature]:
    """The inverse of `features_table` (one row per input column, so collecting is safe)."""
    return [
        numeric(r.name, r.cores) if r.kind == "numeric" else nominal(r.name, r.arity)
        for r in table.orderBy("feature").collect()
    ]


def reindex(features: DataFrame) -> DataFrame:
    """Dense 0-based numbers in `idx` order, for a features table some rows were dropped from."""
    return features.withColumn("idx", F.row_number().over(Window.orderBy("idx")) - 1)
