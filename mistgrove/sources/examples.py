"""Readers of a header with declared attributes and of headerless example files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mistgrove.storage import spread

# Fixed values of the header format: its keywords and the types of numeric attributes.
ATTRIBUTE, OUTPUTS = "@attribute", "@outputs"
NUMERIC_TYPES = ("real", "integer")


def behind(line: Column, keyword: str) -> Column:
    """What follows a keyword in a line, without outer blanks."""
    return F.trim(F.get(F.split(line, keyword, 2), F.lit(1)))


def first_of(text: Column, *marks: str) -> Column:
    """The place of the first of these characters, counted from 1; null without any."""
    return F.least(*[F.nullif(F.instr(text, m), F.lit(0)) for m in marks])


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, kind, lo, hi, values, is_class) of every attribute, in file order.

    Lines other than @attribute and @outputs are ignored. A header is read whole, so that the
    order of its lines does not depend on how files are split.
    """
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")
    )
    told = lines.filter(F.col("line").contains(ATTRIBUTE)).select("line_no", behind(F.col("line"), ATTRIBUTE).alias("told"))
    told = told.withColumn("opens", first_of(F.col("told"), "[", "{"))
    told = told.select("line_no", F.split(F.trim(F.expr("substring(told, 1, opens - 1)")), " +").alias("head"), F.expr("substring(told, opens + 1)").alias("body"))
    declared = told.select(
        "line_no", F.get("head", F.lit(0)).alias("name"), F.coalesce(F.get("head", F.lit(1)), F.lit("")).alias("type"), F.size("head").alias("words"),
        F.col("body").substr(F.lit(1), first_of(F.col("body"), "]", "}") - 1).alias("body"))
    readable = (F.col("name") != "") & (F.col("words") <= 2) & F.col("type").isin("", *NUMERIC_TYPES) & F.col("body").isNotNull()
    if declared.filter(~F.coalesce(readable, F.lit(False))).limit(1).count():
        raise ValueError(f"a line with {ATTRIBUTE} in {path} cannot be parsed")
    declared = declared.select("line_no", "name", "type", F.transform(F.split("body", ","), lambda v: F.trim(v)).alias("parts"))
    outputs = lines.filter(F.col("line").contains(OUTPUTS)).select(behind(F.col("line"), OUTPUTS).alias("output"))
    named = [r.output for r in outputs.collect()]
    if not named:
        raise ValueError(f"{path} names no @outputs")
    kinds = {r.name: r.type for r in declared.where(F.col("name") == named[-1]).select("name", "type").collect()}
    if named[-1] not in kinds:
        raise ValueError(f"@outputs of {path} names {named[-1]!r}, which is no @attribute")
    if kinds[named[-1]]:
        raise ValueError(f"the class {named[-1]!r} of {path} must be nominal")
    is_numeric = F.col("type") != ""
    position = F.row_number().over(Window.orderBy("line_no")) - 1  # a header has few lines
    return declared.select(
        position.alias("idx"), "name",
        F.when(is_numeric, "numeric").otherwise("nominal").alias("kind"),
        F.when(is_numeric, F.get("parts", F.lit(0)).cast("double")).alias("lo"),
        F.when(is_numeric, F.get("parts", F.lit(1)).cast("double")).alias("hi"),
        F.when(~is_numeric, F.col("parts")).alias("values"),
        (F.col("name") == F.lit(named[-1])).alias("is_class"),
    )


def split_fields(line: Column) -> Column:
    """A line's fields without outer blanks; null for an empty one. A comma in double quotes parts no fields."""
    whole = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(whole, lambda f: F.nullif(F.trim(F.regexp_replace(F.trim(f), r'^"(.*)"$', "$1")), F.lit("")))


def number(field: Column) -> Column:
    return field.try_cast("double")


def read_examples(spark: SparkSession, path: str, attributes: DataFrame) -> DataFrame:
    """Comma-separated rows without a header line, typed by the attributes; the class is a column like the others.

    A number that cannot be read ends the job; an empty field is null, which scaling and training refuse.
    """
    fields = [
        T.StructField(r.name, T.DoubleType() if r.kind == "numeric" else T.StringType())
        for r in attributes.orderBy("idx").collect()
    ]
    return spark.read.csv(path, schema=T.StructType(fields), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST")


def sift_examples(spark: SparkSession, path: str, attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The readable rows, typed as `read_examples` types them, and the rejected lines (file, line, reason).

    A line is rejected for a wrong number of fields or for the first field whose number can't be read; empty lines are
    neither. Fields may be quoted. Both tables are views of the same files: lines are read once per table, nothing is collected.
    """
    declared = attributes.orderBy("idx").collect()
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    told = lines.withColumn("fields", split_fields(F.col("line")))
    numbers = [(i, r.name) for i, r in enumerate(declared) if r.kind == "numeric"]
    unread = [F.when(number(F.get("fields", F.lit(i))).isNull() & F.get("fields", F.lit(i)).isNotNull(), F.lit(f"{name}: not a number")) for i, name in numbers]
    miscounted = F.when(F.size("fields") != len(declared), F.concat(F.size("fields").cast("string"), F.lit(f" fields instead of {len(declared)}")))
    told = told.withColumn("reason", F.coalesce(miscounted, *unread))
    typed = [(number(F.get("fields", F.lit(i))) if r.kind == "numeric" else F.get("fields", F.lit(i))).alias(r.name) for i, r in enumerate(declared)]
    return told.where("reason is null").select(*typed), told.where("reason is not null").select("file", "line", "reason")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; one small file is dealt out to all cores."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(table, table.count())  # the count comes from the file footers
