"""Structural checks as violation rows: required fields, patterns, enumerations, uniqueness, time stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of identifiers, event types, digests and time stamps with an offset.
EVENT_ID = r"^evt_[A-Za-z0-9._:-]+$"
EVENT_TYPE = r"^[a-z]+(?:[._][a-z0-9]+)+$"
DIGEST = r"^sha256:[0-9a-f]{64}$"
OFFSET_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def required(name: str) -> tuple[str, Column]:
    return f"{name}_missing", F.col(name).isNull()


def pattern(name: str, regex: str) -> tuple[str, Column]:
    return f"{name}_malformed", F.col(name).isNotNull() & ~F.col(name).rlike(regex)


def one_of(name: str, values: list[str]) -> tuple[str, Column]:
    return f"{name}_unknown", F.col(name).isNotNull() & ~F.col(name).isin(*values)


def at_least(name: str, low: float) -> tuple[str, Column]:
    bad = (F.col(name) < low) | F.isnan(F.col(name).cast("double"))
    return f"{name}_too_small", F.col(name).isNotNull() & bad


def check(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """key, rule of every rule that a row breaks; one pass over df."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))
    return df.select(key, F.explode(broken).alias("rule"))


def not_unique(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
