"""Structured Streaming over event ledgers. An extension: the batch operators are the reference behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..operators.ledger import HUMAN, is_effective


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event_id once, among those that arrive within the delay."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def live_density(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Human intervention density of each window, emitted when the watermark has passed it."""
    human, effective = F.count_if(F.col("event_type") == HUMAN), F.count_if(is_effective())
    return (
        events.withWatermark("occurred_at", delay)
        .groupBy(F.window("occurred_at", window))
        .agg(human.alias("n_human"), effective.alias("n_effective"), ratio(human, effective).alias("density"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_human", "n_effective", "density")
    )
