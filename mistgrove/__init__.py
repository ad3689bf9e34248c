"""Fuzzy partitions and fuzzy classification trees on PySpark DataFrames."""

from mistgrove.features import Feature, nominal, numeric

__all__ = ["Feature", "nominal", "numeric"]
