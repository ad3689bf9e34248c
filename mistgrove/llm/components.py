"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistgrove.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) the columns node, component of all nodes that occur; component is one of its nodes.

    Each round every node points to its smallest neighbour or itself, pointers are followed twice over, and links are drawn
    between the ends; a round shrinks every chain of random numbers several times. Nothing is collected.
    """
    open_links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    found = None
    while not open_links.isEmpty():
        both = open_links.union(open_links.select("b", "a"))
        point = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")), "pointers")
        for _ in range(2):
            onward = point.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            point = stored(point.join(onward, "to", "left").select("node", F.coalesce("beyond", "to").alias("to")), "pointers")
        ends = point.withColumnRenamed("to", "end")
        if found is None:
            found = point.select("node", F.col("to").alias("component"))
        else:
            found = found.join(ends.select(F.col("node").alias("component"), "end"), "component", "left") \
                .select("node", F.coalesce("end", "component").alias("component"))
        found = stored(found, "components")
        drawn = open_links.join(ends.select(F.col("node").alias("a"), F.col("end").alias("x")), "a") \
            .join(ends.select(F.col("node").alias("b"), F.col("end").alias("y")), "b")
        open_links = stored(drawn.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
