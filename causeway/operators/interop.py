"""Projections of events to CloudEvents envelopes and to spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a status that mean failure and success.
ERROR_WORDS = ("fail", "failed", "error", "denied", "blocked", "timeout")
OK_WORDS = ("ok", "pass", "approved", "allow", "confirmed", "succeeded", "executed")


def to_cloudevents(events: DataFrame, type_prefix: str, schema_uri: str) -> DataFrame:
    """Envelope columns; data is the whole event as JSON. source and subject default to the run."""
    return events.select(
        F.lit("1.0").alias("specversion"),
        F.col("event_id").alias("id"),
        F.col("run_id").alias("source"),
        F.concat(F.lit(type_prefix.rstrip(".") + "."), "event_type").alias("type"),
        F.col("actor_type").alias("subject"),
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
        F.lit("application/json").alias("datacontenttype"),
        F.lit(schema_uri).alias("dataschema"),
        F.to_json(F.struct("event_id", "event_type", "ledger_seq", "run_id")).alias("data"),
    )


def from_cloudevents(envelopes: DataFrame, schema: str = "event_id string, event_type string, ledger_seq long, run_id string") -> DataFrame:
    """Events of the envelopes that are of version 1.0 and whose data is an object with the envelope's id."""
    parsed = envelopes.where("specversion = '1.0'").withColumn("_e", F.from_json("data", schema))
    return parsed.where(F.col("_e.event_id") == F.col("id")).select("_e.*")


def trace_id(run_id: Column, given: Column | None = None) -> Column:
    made = F.substring(F.sha2(run_id, 256), 1, 32)
    return made if given is None else F.when(F.length(given) == 32, F.lower(given)).otherwise(made)


def span_id(event_id: Column, given: Column | None = None) -> Column:
    made = F.substring(F.sha2(event_id, 256), 1, 16)
    return made if given is None else F.when(F.length(given) == 16, F.lower(given)).otherwise(made)


def operation(event_type: Column, actor_type: Column) -> Column:
    return (
        F.when(event_type.startswith("plan."), "plan")
        .when(event_type.startswith("tool.") | (actor_type == "tool"), "execute_tool")
        .when(actor_type.isin("agent", "subagent"), "invoke_agent")
    )


def status(raw: Column) -> Column:
    word = F.lower(raw)
    return F.when(word.isin(*ERROR_WORDS), "ERROR").when(word.isin(*OK_WORDS), "OK").otherwise("UNSET")


def _given(events: DataFrame, name: str) -> Column:
    """A column that events may have."""
    return F.col(name) if name in events.columns else F.lit(None).cast("string")


def spans(events: DataFrame) -> DataFrame:
    """One span for each event; parent_span_id only where there is one parent.

    Columns that events may have: actor_id (agents and tools are named by it), status (else the last word of the type says it),
    and trace_id and span_id, which count if they have the right length.
    """
    op = operation(F.col("event_type"), F.col("actor_type"))
    actor = _given(events, "actor_id")
    name = F.when((op != "plan") & (F.coalesce(actor, F.lit("")) != ""), F.concat(op, F.lit(" "), actor)).otherwise(F.coalesce(op, F.col("event_type")))
    word = _given(events, "status") if "status" in events.columns else F.element_at(F.split("event_type", r"\."), -1)
    own = span_id(F.col("event_id"), _given(events, "span_id"))
    single = F.when(F.size("parent_seqs") == 1, F.element_at("parent_seqs", 1))
    parent = events.select(F.col("run_id").alias("_run"), F.col("ledger_seq").alias("_seq"), own.alias("parent_span_id"))
    made = events.select(
        "event_id", name.alias("name"), F.lit("INTERNAL").alias("span_kind"), trace_id(F.col("run_id"), _given(events, "trace_id")).alias("trace_id"), own.alias("span_id"),
        op.alias("operation"), status(word).alias("status"), F.size("parent_seqs").cast("long").alias("parent_count"), "run_id", single.alias("_parent"),
    )
    return made.join(parent, (F.col("run_id") == F.col("_run")) & (F.col("_parent") == F.col("_seq")), "left").select(
        "event_id", "name", "span_kind", "trace_id", "span_id", "parent_span_id", "operation", "status", "parent_count"
    )


def links(events: DataFrame) -> DataFrame:
    """One row for each parent of an event with several: none of them is privileged. position from 0 keeps their order."""
    many = events.where(F.size("parent_seqs") > 1).select("run_id", "event_id", F.posexplode("parent_seqs").alias("position", "_p"))
    parent = events.select("run_id", F.col("ledger_seq").alias("_p"), F.col("event_id").alias("parent_event_id"))
    return many.join(parent, ["run_id", "_p"]).select(
        "event_id",
        F.col("position").cast("long").alias("position"),
        "parent_event_id",
        trace_id(F.col("run_id")).alias("trace_id"),
        span_id(F.col("parent_event_id")).alias("span_id"),
    )


#: Columns that events may have, and the keys of their attributes.
OPTIONAL = {
    "actor_id": "actor.id",
    "branch_id": "branch.id",
    "parallel_group": "parallel.group",
    "join_semantics": "join.semantics",
    "join_quorum": "join.quorum",
    "token_in": "gen_ai.usage.input_tokens",
    "token_out": "gen_ai.usage.output_tokens",
    "reasoning_tokens": "gen_ai.usage.reasoning.output_tokens",
}


def attributes(events: DataFrame) -> DataFrame:
    """event_id, key, value: the span attributes that are set, those of OPTIONAL where events have the columns."""
    op = operation(F.col("event_type"), F.col("actor_type"))
    pairs = {
        "event.id": F.col("event_id"),
        "event.type": F.col("event_type"),
        "run.id": F.col("run_id"),
        "ledger.seq": F.col("ledger_seq").cast("string"),
        "causal.parent.count": F.size("parent_seqs").cast("string"),
        "actor.type": F.col("actor_type"),
        "gen_ai.operation.name": op,
    }
    pairs |= {key: F.col(name).cast("string") for name, key in OPTIONAL.items() if name in events.columns}
    actor = _given(events, "actor_id")
    if "actor_id" in events.columns:
        named = F.when(actor != "", actor)
        pairs |= {"gen_ai.agent.name": F.when(op == "invoke_agent", named), "gen_ai.tool.name": F.when(op == "execute_tool", named)}
    entries = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values()))
    return events.select("event_id", F.explode(F.map_filter(entries, lambda _, v: v.isNotNull())).alias("key", "value"))
