"""Ledger queries: run summaries, budgets, delegation spans, replayed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import ratio
from ..functions.lineage import cut

# Event types that change the state of a run's work.
EFFECTIVE = ("action.completed", "validation.completed", "commit.confirmed", "human.checkpoint.resolved")
HUMAN = "human.checkpoint.resolved"


def is_effective() -> Column:
    return F.col("event_type").isin(*EFFECTIVE)


def run_summary(events: DataFrame) -> DataFrame:
    """Counts of each kind of event, machine time and human intervention density of each run."""
    human, effective = F.count_if(F.col("event_type") == HUMAN), F.count_if(is_effective())
    return events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event_type") == "action.completed").alias("n_actions"),
        F.count_if(F.col("event_type") == "validation.completed").alias("n_validations"),
        F.count_if(F.col("event_type") == "tool.called").alias("n_tool_calls"),
        F.count_if(F.col("event_type") == "commit.confirmed").alias("n_commits"),
        human.alias("n_human"),
        F.sum("machine_runtime_ms").alias("machine_runtime_ms"),
        ratio(human, effective).alias("human_intervention_density"),
    )


def budget_usage(events: DataFrame) -> DataFrame:
    """Machine time and events of each run and actor type."""
    return events.groupBy("run_id", "actor_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("machine_runtime_ms").alias("machine_runtime_ms"), F.max("machine_runtime_ms").alias("longest_ms")
    )


def delegation_spans(events: DataFrame) -> DataFrame:
    """Stretches of a run between human checkpoints; a checkpoint ends the stretch it is in."""
    before = Window.partitionBy("run_id").orderBy("ledger_seq").rowsBetween(Window.unboundedPreceding, -1)
    span = F.coalesce(F.sum(F.when(F.col("event_type") == HUMAN, 1)).over(before), F.lit(0)).cast("long")
    return (
        events.withColumn("span", span)
        .groupBy("run_id", "span")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.min("ledger_seq").alias("first_seq"),
            F.max("ledger_seq").alias("last_seq"),
            (F.unix_micros(F.max("occurred_at")) - F.unix_micros(F.min("occurred_at"))).alias("wall_us"),
            F.sum("machine_runtime_ms").alias("machine_runtime_ms"),
        )
    )


def replay_state(events: DataFrame) -> DataFrame:
    """State after the last event of each run: its last type, and the last place of each kind of confirmation."""
    at = F.col("ledger_seq")
    return events.groupBy("run_id").agg(
        F.max_by("event_type", at).alias("last_event_type"),
        F.max(at).alias("event_offset"),
        F.max(F.when(F.col("event_type") == "commit.confirmed", at)).alias("last_commit_seq"),
        F.max(F.when(F.col("event_type") == "validation.completed", at)).alias("last_validation_seq"),
        F.max(F.when(F.col("event_type") == HUMAN, at)).alias("last_checkpoint_seq"),
    )


def neighbours(events: DataFrame) -> DataFrame:
    """event_id with the ids of its causal parents and children, each in ledger order."""
    place = events.select("run_id", "ledger_seq", "event_id")
    edge = events.select("run_id", F.col("ledger_seq").alias("child_seq"), F.explode("parent_seqs").alias("parent_seq"))
    up = edge.join(place.select("run_id", F.col("ledger_seq").alias("parent_seq"), F.col("event_id").alias("_e")), ["run_id", "parent_seq"])
    down = edge.join(place.select("run_id", F.col("ledger_seq").alias("child_seq"), F.col("event_id").alias("_e")), ["run_id", "child_seq"])

    def ordered(df: DataFrame, own: str, other: str, name: str) -> DataFrame:
        ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(other, "_e"))), lambda x: x["_e"]), ",")
        return df.groupBy("run_id", F.col(own).alias("ledger_seq")).agg(ids.alias(name))

    parents, children = ordered(up, "child_seq", "parent_seq", "parents"), ordered(down, "parent_seq", "child_seq", "children")
    return place.join(parents, ["run_id", "ledger_seq"], "left").join(children, ["run_id", "ledger_seq"], "left").select(
        "event_id", F.coalesce("parents", F.lit("")).alias("parents"), F.coalesce("children", F.lit("")).alias("children")
    )


def false_completions(events: DataFrame) -> DataFrame:
    """Commits confirmed before any validation of their run."""
    first = events.groupBy("run_id").agg(F.min(F.when(F.col("event_type") == "validation.completed", F.col("ledger_seq"))).alias("first_validation"))
    return (
        events.where("event_type = 'commit.confirmed'")
        .join(first, "run_id")
        .where(F.col("first_validation").isNull() | (F.col("ledger_seq") < F.col("first_validation")))
        .select("run_id", "ledger_seq", "event_id")
    )


def quality_adjusted(runs: DataFrame) -> DataFrame:
    """Completion, validation and retention rates multiplied, and 0 where the hard gate fails."""
    return runs.withColumn(
        "quality_adjusted_completion", F.when(F.col("gate"), F.col("q_c") * F.col("q_v") * F.col("q_r")).otherwise(0.0)
    )


def artifact_lineage(events: DataFrame, max_rounds: int = 40) -> DataFrame:
    """artifact_id, upstream_id and is_direct of every artifact that another one was made from, through any number of events.

    events: input_refs and output_refs (arrays of artifact ids, null for none); artifacts cross runs. Each round joins the pairs that
    the last one found with all pairs known so far, so paths double: rounds grow with the logarithm of the longest path. The
    result has one row for each pair, which is what grows. An artifact that comes back to itself is its own upstream.
    """
    made = events.select(F.explode("output_refs").alias("artifact_id"), "input_refs")
    direct = made.select("artifact_id", F.explode("input_refs").alias("upstream_id")).where("artifact_id is not null and upstream_id is not null").distinct()
    known = fresh = direct = cut(direct)
    for _ in range(max_rounds):
        left = fresh.join(known.toDF("upstream_id", "beyond"), "upstream_id").select("artifact_id", F.col("beyond").alias("upstream_id"))
        right = known.join(fresh.toDF("upstream_id", "beyond"), "upstream_id").select("artifact_id", F.col("beyond").alias("upstream_id"))
        fresh = cut(left.union(right).distinct().join(known, ["artifact_id", "upstream_id"], "left_anti"))
        if fresh.isEmpty():
            marked = direct.withColumn("is_direct", F.lit(True))
            return known.join(marked, ["artifact_id", "upstream_id"], "left").select("artifact_id", "upstream_id", F.coalesce("is_direct", F.lit(False)).alias("is_direct"))
        known = cut(known.union(fresh))
    raise RuntimeError(f"lineage has not settled after {max_rounds} rounds")


def attempts(events: DataFrame) -> DataFrame:
    """Each attempt of a run: its first and last place, events, and the type of its last event. Events without attempt_id belong to none."""
    return events.where("attempt_id is not null").groupBy("run_id", "attempt_id").agg(
        F.min("ledger_seq").alias("first_seq"), F.max("ledger_seq").alias("last_seq"), F.count(F.lit(1)).alias("n_events"),
        F.max_by("event_type", F.struct("ledger_seq", "event_type")).alias("last_type"),
    )


def human_checkpoints(events: DataFrame) -> DataFrame:
    """The human checkpoints of each run, numbered from 1 in order."""
    order = Window.partitionBy("run_id").orderBy("ledger_seq", "event_id")
    asked = events.where(F.col("event_type").startswith("human.checkpoint."))
    return asked.select("run_id", F.row_number().over(order).cast("long").alias("checkpoint"), "ledger_seq", "event_id", "event_type")


def run_events(events: DataFrame, run_id: str) -> DataFrame:
    """The events of one run in order."""
    return events.where(F.col("run_id") == run_id).orderBy("ledger_seq", "event_id")
