"""JSONL ledgers: events, records with their line numbers, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.expr import canonical_json


def read_events(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """(events, bad): rows of well-formed lines, and path, line and value of the lines that are no objects of the schema. Blank lines are skipped."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wide = StructType(fields.fields).add("_corrupt_record", "string")
    rows = (
        read_records(spark, path)
        .where("not is_blank")
        .withColumn("value", F.col("record").cast("string"))
        .select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"), "path", "line", "value")
    )
    bad = rows.where("e is null or e._corrupt_record is not null").select("path", "line", "value")
    return rows.where("e is not null and e._corrupt_record is null").select("e.*").drop("_corrupt_record"), bad


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1), record (exact bytes without the LF or CRLF that ends it), is_blank: one row for each line of each file.

    Lines end at line feeds alone and bytes are never decoded, so invalid UTF-8 comes through. A file is read by as many
    tasks as it has splits: rows of a split are numbered as they come, and a split begins after the lines of those before it.
    """
    rows = (
        spark.read.option("lineSep", "\n").text(path)
        .select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    # the lines of a split follow each other in one task, so its first id and their number say all
    splits = rows.groupBy("path", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.join(splits.withColumn("before", F.coalesce(before, F.lit(0))), ["path", "start"])
    size = F.octet_length("raw")
    record = F.when(F.substring("raw", -1, 1) == F.lit(b"\r"), F.substring("raw", F.lit(1), size - 1)).otherwise(F.col("raw"))
    line = (F.col("before") + F.col("id") - F.col("first") + 1).cast("long")
    return numbered.select("path", line.alias("line"), record.alias("record")).withColumn("is_blank", F.col("record").cast("string").rlike(r"\A[ \t\n\r\x0B\f]*\z"))


def record_faults(spark: SparkSession, path: str) -> DataFrame:
    """path, line and code of what keeps a file from being a ledger: blank records by their line, and files without any."""
    # listings say file:///x where scans say file:/x
    told = F.regexp_replace("path", r"^(\w[\w+.-]*):///", "$1:/").alias("path")
    records = read_records(spark, path).select(told, "line", "is_blank")
    blank = records.where("is_blank").select("path", "line", F.lit("blank_record").alias("code"))
    # scans skip files without bytes, so these are in the listing alone
    files = spark.createDataFrame([(x,) for x in spark.read.text(path).inputFiles()], "path string").select(told)
    empty = files.join(records.select("path").distinct(), "path", "left_anti")
    return blank.union(empty.select("path", F.lit(None).cast("long"), F.lit("empty_ledger")))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Compact JSON objects, one for each row: keys sorted at all depths, null fields kept."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(canonical_json(body).alias("value")).write.text(path)
