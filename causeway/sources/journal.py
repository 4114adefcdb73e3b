"""A durable, append-only journal of mutations: batches that are there once, whatever is replayed.

A batch's entries are written under its id first and named in the manifest last. Entries of a batch that the manifest does not
name are not there: a writer that died leaves nothing to see, and its batch is written anew. A batch that the manifest names is never
written again. Works on any file system that Spark writes to, and as the sink of a stream's foreachBatch, whose batch ids repeat on replay.
One writer at a time for each batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.governance import journal_state

ENTRY = "seq long, mutation string, object_id string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def append(entries: DataFrame, path: str, batch: int) -> bool:
    """Add entries (seq, mutation, object_id) as that batch; False, and nothing done, if the journal has it already."""
    spark, named = entries.sparkSession, f"{path}/manifest/batch={int(batch)}"
    if _exists(spark, f"{named}/_SUCCESS"):
        return False
    told = [x.split() for x in ENTRY.split(", ")]
    entries.select(*[F.col(c).cast(t).alias(c) for c, t in told]).write.mode("overwrite").parquet(f"{path}/entries/batch={int(batch)}")
    held = spark.read.schema(ENTRY).parquet(f"{path}/entries/batch={int(batch)}")
    held.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq")).coalesce(1).write.mode("overwrite").parquet(named)
    return True


def sink(path: str):
    """A function for writeStream.foreachBatch."""
    return lambda entries, batch: append(entries, path, batch) and None


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """batch, n and last_seq of all batches that are there."""
    schema = "n long, last_seq long, batch long"
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], schema).select("batch", "n", "last_seq")
    return spark.read.schema(schema).parquet(f"{path}/manifest").select("batch", "n", "last_seq")


def read(spark: SparkSession, path: str) -> DataFrame:
    """batch, seq, mutation and object_id of all entries of batches that are there."""
    if not _exists(spark, f"{path}/entries"):
        return spark.createDataFrame([], f"batch long, {ENTRY}")
    entries = spark.read.schema(f"{ENTRY}, batch long").parquet(f"{path}/entries")
    return entries.join(manifest(spark, path).select("batch"), "batch", "left_semi").select("batch", "seq", "mutation", "object_id")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The audit scan: entries by seq, those of one seq by mutation and object."""
    return read(spark, path).orderBy("seq", "mutation", "object_id")


def state(spark: SparkSession, path: str) -> DataFrame:
    """The latest mutation and the version of each object."""
    return journal_state(read(spark, path))
