"""Cutting lineage and choosing join strategies for the small tables of an iterative job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows (model nodes, cuts) are sent to every executor.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a scratch one only in local mode with none set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mistgrove-"))
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute once, store reliably in the shared folder and forget the lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """A large table as Parquet in the shared folder, read back, and its path: lineage ends here, columns stay compressed."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that `written` wrote and nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table of known row count for broadcasting; a larger one is left to a shuffle join.

    The shuffle join runs under adaptive execution, which splits the hot nodes' partitions.
    """
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame, rows: int, worth: int = 50_000, most: int = 20_000_000) -> DataFrame:
    """Deal out a small table that came in fewer files than there are cores. Looking at the files starts no job.

    Tables above `most` rows are never shuffled for this: they come in enough pieces.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not worth <= rows <= most or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
