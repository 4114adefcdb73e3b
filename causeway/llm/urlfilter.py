"""URL filters: host-suffix and path-prefix expressions, looked up by short hash prefixes.

Each URL is expanded into the expressions host suffix + path prefix that a rule could have: suffixes of as many labels
and prefixes of as many characters as some rule has. Expressions meet rules by the first hexadecimal digits of their
SHA-256 digests, the full digests are then compared, and of the rules that fit the longest expression decides; of equal
ones the one that blocks. URLs that no rule fits get the default verdict.

A null URL, or one without "://", has an empty host and path; no rule fits it. Repeated rows and ids stay as they are.
Rules whose host or path is null are left out. Columns other than page_id and url are not read, names that differ from these
in case alone included. An empty table gives an empty result. Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, keep_only

#: Hexadecimal digits of a digest that are joined on.
PREFIX_DIGITS = 8


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (verdict, host, path)"""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url)."""
    known = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("rule_verdict"),
            F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("chars"),
        )
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    # the shapes of the rules: bounded by the longest rule, whatever their number
    shapes = known.select("labels", "chars").distinct().collect()
    chars = [r["chars"] for r in shapes]
    url = F.col("url")
    named = keep_only(pages, page_id="long", url="string")
    parsed = named.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    if not shapes:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    n_labels = F.size(F.split("host", r"\."))
    expressions = [
        F.when(
            (n_labels >= n) & (F.length("path") >= c),
            F.concat_ws("\n", F.substring_index("host", ".", -n), F.substring("path", 1, c)),
        )
        for n, c in sorted((r["labels"], r["chars"]) for r in shapes)
    ]
    # one row for each distinct host and path prefix: pages of a hot host meet the rules once
    longest = max(chars)
    keyed = parsed.withColumn("head", F.substring("path", 1, longest))
    heads = keyed.select("host", "head").distinct()
    sought = (
        heads.withColumn("path", F.col("head"))
        .select("host", "head", F.explode(F.array_compact(F.array(*expressions))).alias("expression"))
        .select("host", "head", F.sha2("expression", 256).alias("url_digest"))
        .withColumn("prefix", F.substring("url_digest", 1, PREFIX_DIGITS))
    )
    best = F.max_by(
        F.struct("rule", "rule_verdict"),
        F.struct(F.length("rule"), (F.col("rule_verdict") == "block").cast("int"), F.col("rule")),
    )
    decided = (
        sought.join(known, "prefix").where("url_digest = digest").groupBy("host", "head").agg(best.alias("best"))
    )
    return keyed.join(decided, ["host", "head"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
