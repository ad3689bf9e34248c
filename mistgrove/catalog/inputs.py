"""Model inputs derived from the tables: a class with signal, declared attributes, encoded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mistgrove.features import Feature, nominal, numeric
from mistgrove.operators.cuts import min_max
from mistgrove.operators.encode import encode_examples
from mistgrove.sources.examples import read_table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NOMINAL = ["l_returnflag", "l_linestatus"]
CONSTANT = "year_digits"
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
CLASSES = 3
SETS = 5
ATTRIBUTES = "idx int, name string, kind string, lo double, hi double, values array<string>, is_class boolean"


def revenue_class() -> Column:
    """Three classes by quantity * price * (1 - discount)."""
    revenue = F.col("l_quantity") * F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return F.when(revenue < 400000, 0).when(revenue < 1400000, 1).otherwise(2)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with the class and a nominal column that has a single value."""
    return read_table(spark, folder, "lineitem").withColumns({
        "cls": revenue_class(), CONSTANT: F.length(F.year("l_shipdate").cast("string")).cast("string"),
    })


def attributes(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Declared attributes of the model inputs: observed bounds, and nominal values in sorted order."""
    nominals = [*NOMINAL, CONSTANT]
    ends = [f(c).alias(f"{k}_{c}") for c in NUMERIC for k, f in (("lo", F.min), ("hi", F.max))]
    found = df.agg(*ends, *[F.sort_array(F.collect_set(c)).alias(c) for c in nominals]).first()
    rows = [(c, "numeric", found[f"lo_{c}"], found[f"hi_{c}"], None, False) for c in NUMERIC]
    rows += [(c, "nominal", None, None, found[c], False) for c in nominals]
    rows += [("cls", "nominal", None, None, [str(j) for j in range(CLASSES)], True)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ATTRIBUTES)


def even_cores(lo: float, hi: float, sets: int = SETS) -> list[float]:
    """Evenly spaced cores from lo to hi."""
    width = (hi - lo) / (sets - 1)
    return [lo + width * i for i in range(sets)]


def model_inputs(spark: SparkSession, folder: str, sets: int = SETS) -> tuple[DataFrame, list[Feature]]:
    """Encoded lineitem rows with their class, and the features of a tree over them."""
    df = labelled(spark, folder)
    declared = attributes(spark, df)
    features: list[Feature] = []
    for r in declared.orderBy("idx").collect():
        if r.is_class or r.name == CONSTANT:
            continue
        if r.kind == "numeric":
            features.append(numeric(r.name, even_cores(r.lo, r.hi, sets)))
        else:
            features.append(nominal(r.name, len(r["values"])))
    encoded = encode_examples(df.drop(CONSTANT), declared.filter(F.col("name").isin(NOMINAL)))
    return encoded, features


def numeric_features(df: DataFrame, cols: list[str], sets: int = SETS) -> list[Feature]:
    """Even fuzzy sets over the observed range of each column."""
    return [numeric(r.feature, even_cores(r.lo, r.hi, sets)) for r in min_max(df, cols).collect()]


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Whole numbers as bigint and doubles rounded, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, special.get(f.name, digits))
        out.append(c.alias(f.name))
    return df.select(*out)
