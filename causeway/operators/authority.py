"""Records of oversight as they are made and kept: requests, receipts and grants with their faults, and listings of what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .governance import RISK_WEIGHTS, STATUS, with_commands

REQUEST = (
    "approval_id", "run_id", "intent_id", "trigger_event_id", "requested_action", "target", "risk_class", "reason", "options", "evidence_refs",
    "authority_requested", "requested_at", "expires_at",
)
RECEIPT = ("decision_id", "approval_id", "run_id", "principal", "decision", "selected_option", "decided_at", "human_active_ms", "human_governance_ms")
GRANT = ("authority_ref", "decision_id", "principal", "scope", "target", "issued_at", "expires_at", "max_uses", "revocable")


def _made(rows: DataFrame, key: str, required: tuple[str, ...], rules: list[tuple[str, Column]], given: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(made, refused): a row is made if it breaks no rule; refused rows have all rules they break. Columns that rows lack are missing."""
    missing = [(f"{c}_missing", F.col(c).isNull() if c in rows.columns else F.lit(True)) for c in required]
    kept = [(name, F.coalesce(cond, F.lit(False))) for name, cond, *needs in rules if all(c in rows.columns for c in needs)]
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in [*missing, *kept]]))
    judged = rows.withColumn("_broken", broken)
    made = judged.where(F.size("_broken") == 0).select(*[c for c in required if c in rows.columns], *[v.alias(k) for k, v in given.items()])
    return made, judged.where(F.size("_broken") > 0).select(key, F.explode("_broken").alias("rule"))


def _no_time(name: str) -> tuple:
    return f"{name}_malformed", F.col(name).isNotNull() & F.try_to_timestamp(F.col(name).cast("string")).isNull(), name


def make_requests(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, refused) of rows with the REQUEST columns; options is an array. Requests are pending."""
    rules = [
        ("risk_class_unknown", ~F.col("risk_class").isin(*RISK_WEIGHTS), "risk_class"),
        ("options_empty", F.size("options") == 0, "options"),
        _no_time("requested_at"), _no_time("expires_at"),
    ]
    return _made(rows, "approval_id", REQUEST, rules, {"status": F.lit("pending")})


def make_receipts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receipts, refused) of rows with the RECEIPT columns."""
    rules = [
        ("decision_unknown", ~F.col("decision").isin(*STATUS), "decision"),
        ("human_time_negative", (F.col("human_active_ms") < 0) | (F.col("human_governance_ms") < 0), "human_active_ms", "human_governance_ms"),
        _no_time("decided_at"),
    ]
    return _made(rows, "decision_id", RECEIPT, rules, {})


def make_grants(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grants, refused) of rows with the GRANT columns; scope is an array. Grants are active and unused."""
    rules = [
        ("scope_empty", F.size("scope") == 0, "scope"),
        ("max_uses_too_small", F.col("max_uses") < 1, "max_uses"),
        _no_time("issued_at"), _no_time("expires_at"),
    ]
    given = {"uses": F.lit(0).cast("long"), "state": F.lit("active"), "revocation_reason": F.lit(None).cast("string")}
    return _made(rows, "authority_ref", GRANT, rules, given)


def receipt_faults(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """approval_id and rule of receipts that answer no request, and of requests that several answer."""
    n = receipts.groupBy("approval_id").agg(F.count(F.lit(1)).alias("n"))
    known = requests.select("approval_id").distinct()
    orphan = n.join(known, "approval_id", "left_anti").select("approval_id", F.lit("orphan_receipt").alias("rule"))
    return orphan.union(n.where("n > 1").select("approval_id", F.lit("several_receipts")))


def standing(commands: DataFrame, folded: DataFrame) -> DataFrame:
    """approval_id, run_id, expires_at and status of each known approval after the whole log; folded: of fold_approvals."""
    begun = F.when((F.col("kind") == "enqueue") & (F.col("outcome") == "accepted"), F.struct("run_id", "expires_at"))
    last = with_commands(commands, folded.where("status is not null"), "run_id", "expires_at").groupBy("approval_id").agg(
        F.max(begun).alias("begun"), F.max_by("status", "seq").alias("status")
    )
    return last.where("begun is not null").select("approval_id", "begun.run_id", "begun.expires_at", "status")


def pending(commands: DataFrame, folded: DataFrame) -> DataFrame:
    """Approvals that still wait after the log, by expiry and id."""
    return standing(commands, folded).where("status = 'pending'").drop("status").orderBy("expires_at", "approval_id")


def accepted_decisions(commands: DataFrame, folded: DataFrame) -> DataFrame:
    """Decisions that the log took, by instant and id."""
    done = folded.where("kind = 'resolve' and outcome = 'accepted'").drop("status")
    return with_commands(commands, done, "decision_id", "decision", "at", "authority_ref").select("decision_id", "approval_id", "decision", "at", "authority_ref").orderBy("at", "decision_id")


def counts(commands: DataFrame, folded: DataFrame, entries: DataFrame) -> DataFrame:
    """name and n of the four tables that a log leaves: approvals, decisions, grants and mutations."""
    done, kind = with_commands(commands, folded.where("outcome = 'accepted'"), "authority_ref"), F.col("kind")
    kept = {
        "approvals": F.count_if(kind == "enqueue"),
        "decisions": F.count_if(kind == "resolve"),
        "grants": F.count_if((kind == "resolve") & F.col("authority_ref").isNotNull()),
    }
    # the log is read once for the three
    row = done.agg(*[n.alias(name) for name, n in kept.items()])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in kept])).alias("s")
    return row.select(each).select("s.name", "s.n").union(entries.agg(F.lit("mutations").alias("name"), F.count(F.lit(1)).alias("n")))


def id_lists(rows: DataFrame, stale: DataFrame) -> DataFrame:
    """list and id of the requests (rows of timing) and grants that a report lists: open, overdue, deferred and breached ones, stale grants.

    Rows and not arrays: the lists grow with the data.
    """
    lists = F.array_compact(
        F.array(*[F.when(F.col(c), F.lit(name)) for name, c in (("open", "is_open"), ("overdue", "is_overdue"), ("deferred", "is_deferred"), ("explicit_breach", "explicit_breach"))])
    )
    listed = rows.select(F.explode(lists).alias("list"), F.col("approval_id").alias("id"))
    return listed.union(stale.select(F.lit("stale_authority"), "authority_ref")).distinct()


def human_time(receipts: DataFrame) -> DataFrame:
    """Receipts, and the total and mean of the time that people spent on them; a missing time counts as none."""
    ms = F.coalesce(F.col("human_governance_ms"), F.lit(0)).cast("long")
    return receipts.agg(F.count(F.lit(1)).alias("n_receipts"), F.coalesce(F.sum(ms), F.lit(0)).alias("total_ms"), F.avg(ms).alias("mean_ms"))
