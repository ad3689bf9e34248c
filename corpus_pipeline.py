"""A training corpus from a table of documents, in five stages; each one's result is written and read by the next.

    from corpus_pipeline import run
    run(spark, "/data/folder_with_tables").write.parquet("/data/corpus")
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistgrove.llm.common import documents, fresh, stored, with_row, without
from mistgrove.llm.decontaminate import find_leaks
from mistgrove.llm.jaccard import jaccard_groups
from mistgrove.llm.mixing import mixture
from mistgrove.llm.queries import toxicity_model
from mistgrove.llm.resharding import reshard
from mistgrove.llm.toxicity import score_texts

#: A document at or above this score goes.
TOXIC = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under TOXIC, by a model learned from the labelled rows among them; without labels of both kinds all stay."""
    name = fresh(docs.columns, "toxicity")
    scored = score_texts(docs, toxicity_model(docs, spark, sf_dir), keep=tuple(docs.columns), name=name)
    return scored.where(F.col(name) < TOXIC).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles, the one of the smallest doc_id (null last, then the first row).

    Decisions are made by row, so a null or repeated doc_id is like any other. Documents without words are no group and stay.
    """
    rows, row = with_row(docs)
    groups = jaccard_groups(rows, key=row, width=5, percent=80).select(F.col(row).alias("member"), F.col("component_id").alias("head"))
    others = stored(groups.where("member <> head"), "pipeline-groups")
    members = others.unionByName(others.select("head", F.col("head").alias("member")).distinct())
    own = rows.select(F.col(row).alias("member"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "member")
    named = stored(members.join(own, "member"), "pipeline-members")
    kept = named.groupBy("head").agg(F.min(order)["member"].alias("member"))
    return without(rows, named.join(kept, "member", "left_anti").select("member"), row).drop(row)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; decided by row, whatever its doc_id."""
    rows, row = with_row(docs)
    return without(rows, find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=row).select(row), row).drop(row)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: to 150 % of all words, sources weighed 5, 2, 1 in turn."""
    return mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place (shard, slot) in eight shards of even bytes, moved as little as can be from those by source.

    An input column named like one of the plan's goes out with underscores before its name.
    """
    old = (F.crc32(F.col("source").cast("binary")) % 8).cast("int")
    return reshard(docs, old, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard", one_of_each_group),
    ("decontamination", without_leaks),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL can't express the trained stages; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; intermediate results lie in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
