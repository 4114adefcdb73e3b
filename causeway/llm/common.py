"""Shared pieces: lineage cuts, gapless numbering, connected components, labelled samples."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut, ensure_checkpoint_dir

#: Rows of one (key, bucket) group are numbered by one task; a key of n rows gives groups of about n / BUCKETS.
BUCKETS = 1024


class Scratch:
    """Written tables in the shared checkpoint folder, compressed and columnar, that can be dropped one by one."""

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.top = spark, f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        self.made: list[str] = []

    def fresh(self, stem: str) -> str:
        """A name not given before."""
        self.made.append(f"{stem}{len(self.made)}")
        return self.made[-1]

    def put(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        df.write.options(**options).parquet(f"{self.top}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def shuffles_released(spark: SparkSession):
    """Within it, each finished action gives back its shuffle files at once instead of when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast; extra columns are left out, those whose names differ in case alone too.

    Columns are renamed by position first: a name that stands twice but for its case is ambiguous to Spark. Of two
    columns of the very same name the first counts.
    """
    placed = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return placed.select(*[F.col(f"_{place_of(df, c)}").cast(t).alias(c) for c, t in types.items()])


def place_of(df: DataFrame, name: str) -> int:
    """Where the column of that very name stands, or else the first that differs in case alone."""
    return df.columns.index(name) if name in df.columns else [x.lower() for x in df.columns].index(name.lower())


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, key: str, by: str, out: str, buckets: int | Column = BUCKETS, bucket: Column | None = None) -> DataFrame:
    """Number the rows of each key gaplessly from 0 without one task ever holding a whole key.

    Rows go to hash buckets of ``by``, or to the ``bucket`` given; each (key, bucket) is numbered in a task of its own and starts where the
    buckets before it end. The only per-key work is a running sum over at most ``buckets`` counts.
    """
    if bucket is None:
        bucket = F.pmod(F.xxhash64(by), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int")
    dealt = df.withColumn("_bucket", bucket)
    counts = dealt.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_bucket").orderBy(by)
    return (
        dealt.withColumn("_i", F.row_number().over(within) - 1)
        .join(starts, [key, "_bucket"])
        .withColumn(out, (F.col("_start") + F.col("_i")).cast("long"))
        .drop("_bucket", "_i", "_start")
    )


def components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge: component is the smallest node reachable.

    edges has long columns a, b. Alternates the large-star and small-star steps: each round every node hangs its
    neighbours under the smallest of them, which halves paths; rounds grow with the logarithm of the diameter.
    Every round is an aggregation and a join of edge rows, cut to the shared checkpoint folder. A node of very many
    neighbours is only ever aggregated (min) and joined, never gathered. Raises if it has not settled after max_rounds.
    """
    e = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours greater than u hang under u's minimum
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: smaller neighbours, and u itself, hang under the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hung = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        nxt = cut(hung)
        # settled when every node hangs under one root and no root hangs under another
        loose = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not loose:
            roots = nxt.select(F.col("v").alias("r")).distinct()
            loose = nxt.join(roots, nxt.u == roots.r, "left_semi").limit(1).count()
        e = nxt
        if not loose:
            found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            top = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return found.union(top)
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) of about ``bound`` labelled documents at most, or of all where there are fewer.

    usable says of a doc_id which labels may be learnt. Rows are drawn by the hash of their doc_id, so the sample
    does not depend on order or partitions. Null ids and labels are left out; of repeated labels the largest counts.
    The drawn labels are bounded, so they are broadcast and texts are not shuffled.
    """
    known = (
        keep_only(labels, doc_id="long", **{label: "int"}).withColumnRenamed(label, "y")
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    return keep_only(docs, doc_id="long", text="string").join(F.broadcast(known), "doc_id")
