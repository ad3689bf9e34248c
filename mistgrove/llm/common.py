"""What several operators share: word counts, letter case, stored tables and batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mistgrove.storage import shared_folder

#: Letters that case folding touches; all others stay.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word: a run of anything but ASCII white space. bytes.split() of UTF-8 text gives the same runs.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. The quick form serves texts of one byte per character."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(key: Column, classes: int) -> Column:
    """crc32 of the key's text, modulo classes; null counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % classes


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table into the folder all executors share and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results not yet written can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hash_limit(part: float) -> int:
    """The 64-bit hash up to which lies this part of all hashes."""
    return min(2**63 - 1, int(part * 2**64) - 2**63)


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts (column number text, binary) of each hold about `most` bytes; a text stays whole."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table with a new column of different row numbers, and that column's name.

    Rows are numbered by their place in the files, which is the same for every reader; a table that is not read from files is stored first.
    """
    name = fresh(docs.columns, "row")
    files = docs if docs.inputFiles() else stored(docs, "numbered")
    return files.withColumn(name, F.monotonically_increasing_id()), name


def without(docs: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs whose key is not among ids (one column); rows without a key stay. Texts are shuffled only where ids are many."""
    gone = fresh(docs.columns, "gone")
    ids = ids.toDF(gone)
    ids = stored(ids.where(F.col(gone).isNotNull()).distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, F.col(key) == F.col(gone), "left_anti")


def attach(rows: DataFrame, groups: DataFrame, key: str, members: Column, total: int, share: int = 1000) -> DataFrame:
    """Left join rows with one row per group, whatever share of the rows a group holds.

    Groups of more than total / share rows are fewer than `share`, so they are broadcast; the others are
    joined by a shuffle in which none of them can weigh more than that.
    """
    large = groups.where(members * share > total)
    small = groups.where(~(members * share > total))
    values = [c for c in groups.columns if c != key]
    hot = large.select(F.col(key), F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(small, key, "left")
    return marked.where(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in values]) \
        .unionByName(cold.select(*rows.columns, *values))
