"""Approvals, decisions and grants: metrics, signals, eligibility and the state machine over a command log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..functions.expr import first_code, ms_between, ratio, reasons

# Fixed values of the default policy.
RISK_WEIGHTS = {"low": 1.0, "medium": 2.0, "high": 4.0, "critical": 8.0}
DEBT_MULTIPLIERS = {"unresolved": 1.0, "overdue": 1.0, "deferred": 0.5, "stale_authority": 1.0}
CLOSING = ("approve", "deny", "modify", "cancel")
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
ESCALATION = {
    "clear": "none",
    "info": "watch",
    "low": "watch",
    "medium": "review",
    "high": "priority_review",
    "critical": "urgent_human_review",
}
#: (code, threshold, comparator that clears, severity, unit)
SIGNALS = (
    ("autonomy_governance_gap", 0.0, "<=", "critical", "interaction_depth"),
    ("effective_oversight_density_low", 0.50, ">=", "high", "ratio"),
    ("oversight_debt_high", 20.0, "<=", "high", "policy_weight"),
    ("escalation_latency_p95_high", 1_800_000.0, "<=", "medium", "milliseconds"),
    ("explicit_intervention_deadline_breach", 0.0, "<=", "critical", "count"),
    ("critical_oversight_coverage_low", 0.75, ">=", "critical", "ratio"),
)


def weight_of(risk: Column, weights: dict[str, float] = RISK_WEIGHTS) -> Column:
    out = F.lit(None).cast("double")
    for name, w in weights.items():
        out = F.when(risk == name, F.lit(w)).otherwise(out)
    return out


def timing(requests: DataFrame, receipts: DataFrame, at: Column) -> DataFrame:
    """One row for each request: its deadline, what was decided and how it stands at the instant ``at``.

    The status of a request is not looked at; openness comes from receipts alone. A decision is timely at its deadline,
    and an open request is overdue after it.
    """
    joined = requests.join(receipts.select("approval_id", "decision", "decided_at", "human_governance_ms"), "approval_id", "left")
    explicit = F.col("explicit_deadline").isNotNull()
    deadline = F.coalesce("explicit_deadline", "expires_at")
    closing = F.coalesce(F.col("decision").isin(*CLOSING), F.lit(False))
    timely = F.col("decided_at") <= deadline
    latency, window = ms_between(F.col("requested_at"), F.col("decided_at")), ms_between(F.col("requested_at"), deadline)
    return joined.select(
        "approval_id",
        "risk_class",
        weight_of(F.col("risk_class")).alias("weight"),
        "decision",
        deadline.alias("deadline_at"),
        F.when(explicit, "explicit_intervention_deadline").otherwise("approval_expiry").alias("deadline_basis"),
        latency.alias("latency_ms"),
        ratio(latency, window).alias("latency_ratio"),
        ms_between(F.col("decided_at"), deadline).alias("margin_ms"),
        (closing & timely).alias("is_effective"),
        closing.alias("is_closed"),
        (~closing).alias("is_open"),
        (F.col("decision") == "defer").eqNullSafe(True).alias("is_deferred"),
        (~closing & (at > deadline)).alias("is_overdue"),
        F.when(~closing, ms_between(F.col("requested_at"), at)).alias("open_age_ms"),
        (explicit & F.when(closing, ~timely).otherwise(at > deadline)).alias("explicit_breach"),
        F.coalesce("human_governance_ms", F.when(F.col("decision").isNotNull(), F.lit(0))).cast("long").alias("human_governance_ms"),
    )


def risk_coverage(rows: DataFrame) -> DataFrame:
    """The four risk classes, zero-filled."""
    classes = rows.sparkSession.createDataFrame([(k,) for k in RISK_WEIGHTS], "risk_class string")
    got = rows.groupBy("risk_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_effective").alias("e"),
        F.count_if("is_closed").alias("c"),
        F.count_if("is_open").alias("o"),
    )
    zero = F.lit(0).cast("long")
    n, e = F.coalesce("n", zero), F.coalesce("e", zero)
    return classes.join(got, "risk_class", "left").select(
        "risk_class",
        n.alias("opportunities"),
        e.alias("effective"),
        F.coalesce("c", zero).alias("closed"),
        F.coalesce("o", zero).alias("open"),
        (n * weight_of(F.col("risk_class"))).alias("weight_total"),
        (e * weight_of(F.col("risk_class"))).alias("weight_effective"),
        ratio(e, n).alias("coverage"),
    )


def latency(rows: DataFrame) -> DataFrame:
    """Count, mean, nearest-rank percentiles and maximum of the latency of all decisions, deferrals too."""
    decided = rows.where("latency_ms is not null")
    return decided.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("latency_ms").alias("mean_ms"),
        F.expr("percentile_disc(0.5) within group (order by latency_ms)").cast("long").alias("p50_ms"),
        F.expr("percentile_disc(0.95) within group (order by latency_ms)").cast("long").alias("p95_ms"),
        F.max("latency_ms").alias("max_ms"),
    )


def stale_grants(grants: DataFrame, receipts: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Grants that are active though past their expiry, with the weight of their request."""
    return (
        grants.where((F.col("state") == "active") & (at > F.col("expires_at")))
        .select("authority_ref", "decision_id")
        .join(receipts.select("decision_id", "approval_id"), "decision_id")
        .join(requests.select("approval_id", "risk_class"), "approval_id")
        .select("authority_ref", weight_of(F.col("risk_class")).alias("weight"))
    )


def debt(rows: DataFrame, stale: DataFrame) -> DataFrame:
    """component, n, weight and weighted debt of the four kinds of oversight debt."""
    kinds = {"unresolved": "is_open", "overdue": "is_overdue", "deferred": "is_deferred"}
    flat = rows.select("weight", F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*kinds.values()))).alias("component", "holds"))
    all_rows = flat.where("holds").select("component", "weight").union(stale.select(F.lit("stale_authority"), "weight"))
    names = rows.sparkSession.createDataFrame(list(DEBT_MULTIPLIERS.items()), "component string, multiplier double")
    got = all_rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    w = F.coalesce("w", F.lit(0.0))
    return names.join(got, "component", "left").select(
        "component", F.coalesce("n", F.lit(0).cast("long")).alias("n"), w.alias("weight"), (w * F.col("multiplier")).alias("debt")
    )


def metrics(rows: DataFrame, debts: DataFrame, events: DataFrame) -> DataFrame:
    """One row: densities, counts, debt and human time."""
    totals = rows.agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count("decision").alias("n_decisions"),
        F.count_if("is_effective").alias("n_effective"),
        F.count_if("is_open").alias("n_open"),
        F.count_if("is_overdue").alias("n_overdue"),
        F.count_if("explicit_breach").alias("n_explicit_breaches"),
        ratio(F.sum(F.when(F.col("is_effective"), F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("effective_oversight_density"),
        ratio(
            F.count_if(F.col("is_effective") & (F.col("risk_class") == "critical")), F.count_if(F.col("risk_class") == "critical")
        ).alias("critical_coverage"),
        F.coalesce(F.sum("human_governance_ms"), F.lit(0)).cast("long").alias("human_governance_ms"),
        F.expr("percentile_disc(0.95) within group (order by latency_ms)").cast("long").alias("p95_ms"),
    )
    owed = debts.agg(F.sum("debt").alias("oversight_debt"))
    from .ledger import HUMAN, is_effective

    hid = events.agg(ratio(F.count_if(F.col("event_type") == HUMAN), F.count_if(is_effective())).alias("human_intervention_density"))
    # one row each
    return totals.join(owed).join(hid)


def horizon_gap(assessments: DataFrame) -> DataFrame:
    """assessment_id, autonomy_governance_gap, governance_margin and violations, in order, for each assessment.

    assessments: (assessment_id, unit, reliability_p, scope_id, assessment_method, h_autonomy, h_governance). Gap and margin are
    null where the contract is broken or a horizon is null: without support on either side there is nothing to compare.
    """
    broken = {
        "unit_not_interaction_depth": ~F.col("unit").eqNullSafe("interaction_depth"),
        "reliability_out_of_range": ~F.coalesce((F.col("reliability_p") > 0) & (F.col("reliability_p") <= 1), F.lit(False)),
        "scope_missing": F.coalesce(F.col("scope_id"), F.lit("")) == "",
        "method_missing": F.coalesce(F.col("assessment_method"), F.lit("")) == "",
        "negative_depth": F.coalesce(F.least("h_autonomy", "h_governance") < 0, F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(test, code) for code, test in broken.items()]))
    gap = F.when(F.size("violations") == 0, F.col("h_autonomy") - F.col("h_governance"))
    out = assessments.withColumn("violations", found).withColumn("autonomy_governance_gap", gap)
    return out.select("assessment_id", "autonomy_governance_gap", (-F.col("autonomy_governance_gap")).alias("governance_margin"), "violations")


def signals(measured: DataFrame) -> DataFrame:
    """Six rows: code, observed, threshold, status and severity. measured: one row with a column for each code."""
    rows = [
        F.struct(
            F.lit(code).alias("code"),
            F.col(code).cast("double").alias("observed"),
            F.lit(threshold).alias("threshold"),
            F.lit(comparator).alias("comparator"),
            F.lit(severity).alias("severity"),
            F.lit(unit).alias("unit"),
        )
        for code, threshold, comparator, severity, unit in SIGNALS
    ]
    clear = F.when(F.col("comparator") == "<=", F.col("observed") <= F.col("threshold")).otherwise(F.col("observed") >= F.col("threshold"))
    state = F.when(F.col("observed").isNull(), "not_applicable").when(clear, "clear").otherwise("breach")
    return measured.select(F.explode(F.array(*rows)).alias("s")).select("s.*").withColumn("status", state)


def overall_level(found: DataFrame) -> DataFrame:
    """level, escalation and number of breaches: the worst severity among the breaches."""
    breach = F.when(F.col("status") == "breach", F.col("severity"))
    rank = F.lit(None).cast("int")
    for name, n in SEVERITY_RANK.items():
        rank = F.when(breach == name, n).otherwise(rank)
    advice = F.create_map(*[F.lit(x) for kv in ESCALATION.items() for x in kv])
    worst = found.agg(F.max_by(breach, rank).alias("worst"), F.count(breach).alias("n_breaches"))
    level = F.coalesce("worst", F.lit("clear"))
    return worst.select(level.alias("level"), F.element_at(advice, level).alias("escalation"), "n_breaches")


def resume_eligibility(asked: DataFrame, requests: DataFrame, receipts: DataFrame, grants: DataFrame) -> DataFrame:
    """Whether each ask may resume, with the ordered reasons that it may not.

    asked: approval_id, decision_id and authority_ref (of the request, receipt and grant it relies on; each may be null or
    unknown), action, target and the instant at. A grant's scope is an array of actions.
    """
    rows = (
        asked.join(requests.select("approval_id", F.lit(True).alias("known")), "approval_id", "left")
        .join(receipts.select("decision_id", "decision", F.col("approval_id").alias("r_approval")), "decision_id", "left")
        .join(
            grants.select("authority_ref", F.col("decision_id").alias("g_decision"), "state", "uses", "max_uses", "expires_at", "scope", F.col("target").alias("g_target")),
            "authority_ref",
            "left",
        )
    )
    decided, has = F.col("decision").isNotNull(), F.col("max_uses").isNotNull()
    state, uses = F.coalesce("state", F.lit("active")), F.coalesce("uses", F.lit(0))
    spent = state.isin("consumed", "exhausted") | (uses >= F.col("max_uses"))
    codes = reasons(
        (~F.coalesce(F.col("decision").isin("approve", "modify"), F.lit(False)), "decision_not_authorizing"),
        (~has, "authority_missing"),
        (has & (state == "revoked"), "authority_revoked"),
        (has & (state != "revoked") & spent, "authority_exhausted"),
        (has & (F.col("at") > F.col("expires_at")), "authority_expired"),
        (has & ~F.coalesce(F.array_contains("scope", F.col("action")), F.lit(False)), "scope_mismatch"),
        (has & ~F.col("target").eqNullSafe(F.col("g_target")), "target_mismatch"),
        (has & decided & ~F.col("g_decision").eqNullSafe(F.col("decision_id")), "decision_authority_mismatch"),
        (has & decided & ~F.col("r_approval").eqNullSafe(F.when(F.col("known"), F.col("approval_id"))), "approval_decision_mismatch"),
    )
    return rows.select(
        "approval_id",
        "decision_id",
        F.when(has, F.col("authority_ref")).alias("authority_ref"),
        (F.size(codes) == 0).alias("eligible"),
        F.array_join(codes, ",").alias("reasons"),
        F.when(has, F.greatest(F.lit(0).cast("long"), (F.col("max_uses") - uses).cast("long"))).otherwise(F.lit(0).cast("long")).alias("remaining_uses"),
    )


#: The status that an accepted decision leaves.
STATUS = {"approve": "approved", "deny": "denied", "modify": "modified", "defer": "deferred", "cancel": "cancelled"}


def _same(name: str):
    """All rows of one value; a null is a value of its own for each row."""
    return Window.partitionBy(name, F.when(F.col(name).isNull(), F.col("seq")))


def settle_claims(claims: DataFrame, names: list[str]) -> DataFrame:
    """The claims that win when they are taken in order of seq: each asks for its values under ``names``, and wins if no winner has one of them.

    A claim that is the first of all for each of its values wins at once, and those of its first name are done. A claim
    whose other values no one else asks for wins if none before it does, so what comes after it under its first name is out. What is left
    is settled in rounds: a claim that is the first of all open ones for each of its values wins, open claims that share a
    value with a winner lose. Each round is a window for each name over the open claims, cut to the checkpoint folder;
    rounds grow with the longest chain of claims that wait for each other, rows shrink with each.
    """
    return _settle(claims, names)[0].drop("_alone")


def _settle(claims: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(winners, contested): those of settle_claims, and the claims that did not win at once; _alone: whether no other claim has one of the further values."""
    columns, head = [*claims.columns, "_alone"], Window.partitionBy(names[0])
    first, alone = F.lit(True), F.lit(True)
    for name in names[1:]:
        first = first & (F.min("seq").over(_same(name)) == F.col("seq"))
        alone = alone & (F.col(name).isNull() | (F.count(F.lit(1)).over(_same(name)) == 1))
    known = claims.withColumns({"_won": first, "_alone": alone})
    known = known.withColumns({"_won": F.col("_won") & (F.min("seq").over(head) == F.col("seq")), "_stop": F.min(F.when(F.col("_alone"), F.col("seq"))).over(head)})
    known = known.withColumn("_done", F.max("_won").over(head))
    open_too = ~F.col("_done") & (F.col("seq") <= F.coalesce("_stop", "seq"))
    known = cut(known.where(F.col("_won") | open_too).select(*columns, "_won"))
    out, contested = known.where("_won").select(*columns), known.where("not _won").select(*columns)
    open_ = contested
    for name in names[1:]:
        taken = out.where(~F.col("_alone") & F.col(name).isNotNull()).select(name).distinct()
        open_ = open_.join(taken, name, "left_anti")
    open_ = cut(open_.select(*columns))
    every = [head, *map(_same, names[1:])]
    while not open_.isEmpty():
        first = F.lit(True)
        for over in every:
            first = first & (F.min("seq").over(over) == F.col("seq"))
        marked = open_.withColumn("_won", first)
        beaten = F.lit(False)
        for over in every:
            beaten = beaten | F.max("_won").over(over)
        marked = cut(marked.withColumn("_beaten", beaten).where("_won or not _beaten"))
        out = out.union(marked.where("_won").select(*columns))
        open_ = marked.where("not _won").select(*columns)
    return out, contested


def fold_approvals(commands: DataFrame, *kept: str) -> DataFrame:
    """The outcome of each command of a log on approvals; refused ones change nothing.

    commands: seq (their order), approval_id, kind, and by kind: enqueue (run_id, expires_at); resolve (decision_id,
    decision, run_id, at, and for a grant authority_ref and grant_decision_id); expire (at). Returns seq, approval_id,
    kind, outcome (accepted, or why not), status (of the approval afterwards) and the commands' columns ``kept``. seq is unique. A pending approval leaves
    that state once, at its first sound resolution or due expiry that is not refused for an id of a decision or grant that
    an accepted one took before: see settle_claims. Commands are moved by approval twice: to find the claims, and beside the claims' verdicts.
    """
    of_approval = Window.partitionBy("approval_id")
    kind, has_grant = F.col("kind"), F.col("authority_ref").isNotNull()
    flaw = first_code(
        [
            (~F.col("run_id").eqNullSafe(F.col("q.run_id")), "run_mismatch"),
            (F.col("at") > F.col("q.expires_at"), "expired_before_decision"),
            (~F.col("decision").isin(*STATUS), "unknown_decision"),
            (has_grant & ~F.col("decision").isin("approve", "modify"), "grant_not_allowed"),
            (has_grant & ~F.col("grant_decision_id").eqNullSafe(F.col("decision_id")), "grant_decision_mismatch"),
        ]
    )

    def judged(rows: DataFrame) -> DataFrame:
        begun = F.min(F.when(kind == "enqueue", F.struct("seq", "run_id", "expires_at"))).over(of_approval)
        return rows.withColumn("q", begun).withColumns(
            {"known": F.coalesce(F.col("q.seq") < F.col("seq"), F.lit(False)), "flaw": F.when(kind == "resolve", flaw)}
        )

    rows, resolves = judged(commands), kind == "resolve"
    sound = resolves & F.col("known") & F.col("flaw").isNull()
    due = (kind == "expire") & F.col("known") & (F.col("at") >= F.col("q.expires_at"))
    leaves = F.when(resolves, status_of(F.col("decision"))).otherwise("expired")
    claims = rows.where(sound | due).select(
        "seq", "approval_id", F.when(resolves, F.col("decision_id")).alias("decision_id"), F.when(resolves, F.col("authority_ref")).alias("authority_ref"), leaves.alias("leaves")
    )
    won, contested = _settle(claims, ["approval_id", "decision_id", "authority_ref"])
    # a sound resolution of a pending approval that did not win was beaten to its decision id, or else to its grant
    takers = won.where("not _alone and decision_id is not null").select("decision_id", F.col("seq").alias("taken_at"))
    twice = contested.join(takers, "decision_id").where("taken_at < seq")
    verdicts = won.select("approval_id", "seq", "leaves").union(twice.select("approval_id", "seq", F.lit(None).cast("string")))
    names = list(dict.fromkeys(["seq", "approval_id", "kind", "run_id", "expires_at", "decision_id", "decision", "at", "authority_ref", "grant_decision_id", *kept]))
    asked = commands.select(*names, F.lit(None).cast("string").alias("leaves"))
    told = verdicts.select(*[F.col(c) if c in ("seq", "approval_id") else F.lit(None).cast(commands.schema[c].dataType).alias(c) for c in names], "leaves")
    verdict = F.col("_verdict")
    rows = judged(asked.withColumn("_verdict", F.lit(False)).union(told.withColumn("_verdict", F.lit(True))))
    rows = rows.withColumns(
        {
            "left_at": F.min(F.when(F.col("leaves").isNotNull(), F.struct("seq", F.col("leaves").alias("status")))).over(of_approval),
            "taken": F.max(verdict & F.col("leaves").isNull()).over(Window.partitionBy("approval_id", "seq")),
        }
    ).where(~verdict)
    gone = F.coalesce(F.col("left_at.seq") < F.col("seq"), F.lit(False))
    lost = ~F.col("left_at.seq").eqNullSafe(F.col("seq"))
    refused = (
        F.when((kind == "enqueue") & (F.col("q.seq") < F.col("seq")), "duplicate_approval_id")
        .when((kind != "enqueue") & ~F.col("known"), "unknown_approval")
        .when((kind != "enqueue") & gone, "not_pending")
        .when(resolves, F.coalesce("flaw", F.when(lost, F.when(F.col("taken"), "duplicate_decision_id").otherwise("duplicate_authority_ref"))))
        .when((kind == "expire") & (F.col("at") < F.col("q.expires_at")), "not_due")
    )
    after = F.when(F.col("q.seq").isNull() | (F.col("q.seq") > F.col("seq")), None).when(F.col("left_at.seq") <= F.col("seq"), F.col("left_at.status")).otherwise("pending")
    return rows.select("seq", "approval_id", "kind", F.coalesce(refused, F.lit("accepted")).alias("outcome"), after.alias("status"), *[c for c in kept if c not in ("seq", "approval_id", "kind")])


def with_commands(commands: DataFrame, folded: DataFrame, *columns: str) -> DataFrame:
    """folded rows with those columns of their commands, joined unless fold_approvals kept them."""
    lacking = [c for c in columns if c not in folded.columns]
    return folded.join(commands.select("seq", *lacking), "seq") if lacking else folded


def status_of(decision: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), decision)


def fold_grants(grants: DataFrame, commands: DataFrame) -> DataFrame:
    """The outcome of each command of a log on grants, in order of seq within a grant; refused ones change nothing.

    grants: authority_ref, state, uses, max_uses, expires_at, scope (array), target, revocable. commands: seq,
    authority_ref, kind (consume or revoke), action, target, at. Returns seq, authority_ref, kind, outcome, and state and
    uses of the grant afterwards. A grant that is not active, whether spent, expired or revoked before, refuses every use,
    and so does one whose given uses have reached max_uses;
    a use after the expiry leaves it expired; a revocation needs a revocable grant. Running counts over a grant's commands.
    """
    known = grants.select(
        "authority_ref", "max_uses", F.col("expires_at").alias("ends"), "scope", F.col("target").alias("g_target"), "revocable",
        F.coalesce("state", F.lit("active")).alias("state0"), F.coalesce("uses", F.lit(0)).cast("long").alias("uses0"),
    )
    rows = commands.join(known, "authority_ref", "left")
    use, exists = F.col("kind") == "consume", F.col("max_uses").isNotNull()
    flaw = first_code(
        [
            (F.col("at") > F.col("ends"), "authority_expired"),
            (~F.coalesce(F.array_contains("scope", F.col("action")), F.lit(False)), "scope_mismatch"),
            (~F.col("target").eqNullSafe(F.col("g_target")), "target_mismatch"),
        ]
    )
    rows = rows.withColumn("flaw", F.when(use, flaw))
    before = Window.partitionBy("authority_ref").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("authority_ref").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    good, late = use & F.col("flaw").isNull(), use & F.col("flaw").eqNullSafe("authority_expired")
    revokes = (F.col("kind") == "revoke") & F.coalesce("revocable", F.lit(False))

    def so_far(cond: Column, over) -> Column:
        return F.coalesce(F.count_if(cond).over(over), F.lit(0))

    rows = rows.withColumns(
        {"used": so_far(good, before), "stopped": so_far(late | revokes, before), "revoked": so_far(revokes, upto)}
    )
    active = (F.col("state0") == "active") & (F.col("stopped") == 0) & (F.col("uses0") + F.col("used") < F.col("max_uses"))
    outcome = first_code(
        [
            (~exists, "unknown_authority"),
            ((F.col("kind") == "revoke") & ~F.coalesce("revocable", F.lit(False)), "not_revocable"),
            (use & ~active, "authority_not_active"),
            (use & F.col("flaw").isNotNull(), "refused"),
        ]
    )
    outcome = F.when(outcome == "refused", F.col("flaw")).otherwise(F.coalesce(outcome, F.lit("accepted")))
    rows = rows.withColumn("outcome", outcome)
    uses = F.col("uses0") + so_far(use & (F.col("outcome") == "accepted"), upto)
    expired = so_far(use & (F.col("outcome") == "authority_expired"), upto) > 0
    state = (
        F.when(F.col("revoked") > 0, "revoked").when(F.col("state0") != "active", F.col("state0")).when(expired, "expired").when((uses > F.col("uses0")) & (uses >= F.col("max_uses")), "consumed").otherwise("active")
    )
    return rows.select("seq", "authority_ref", "kind", "outcome", F.when(exists, state).alias("state"), F.when(exists, uses).alias("uses"))


def expire_due(requests: DataFrame, receipts: DataFrame, at: Column) -> DataFrame:
    """Status of each request at ``at``: an unanswered one expires at its expiry; a decision after it is rejected."""
    in_time = receipts.select("approval_id", "decision", "decided_at")
    status = (
        F.when(F.col("decision").isNull() & (at >= F.col("expires_at")), "expired")
        .when(F.col("decision").isNull(), "pending")
        .when(F.col("decided_at") > F.col("expires_at"), "expired")
        .when(F.col("decision") == "approve", "approved")
        .when(F.col("decision") == "modify", "modified")
        .when(F.col("decision") == "deny", "denied")
        .when(F.col("decision") == "defer", "deferred")
        .otherwise("cancelled")
    )
    return requests.join(in_time, "approval_id", "left").select("approval_id", status.alias("status"))


def journal(approvals: DataFrame, folded_approvals: DataFrame, folded_grants: DataFrame) -> DataFrame:
    """Append-only mutations of the eight kinds that accepted commands leave: seq, mutation and object_id.

    approvals: the commands that were folded into folded_approvals. An expired use leaves a mutation though it is refused.
    """
    done = with_commands(approvals, folded_approvals.where("outcome = 'accepted'"), "decision_id", "authority_ref")

    def entry(cond: Column, mutation: str, object_id: str) -> Column:
        return F.when(cond, F.struct(F.lit(mutation).alias("mutation"), F.col(object_id).alias("object_id")))

    def told(df: DataFrame, *entries: Column) -> DataFrame:
        # each log is read once
        return df.select("seq", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("seq", "e.mutation", "e.object_id")

    kind, used = F.col("kind"), F.col("outcome") == "accepted"
    return told(
        done,
        entry(kind == "enqueue", "approval.enqueued", "approval_id"),
        entry(kind == "resolve", "approval.resolved", "approval_id"),
        entry(kind == "resolve", "decision.recorded", "decision_id"),
        entry((kind == "resolve") & F.col("authority_ref").isNotNull(), "authority.granted", "authority_ref"),
        entry(kind == "expire", "approval.expired", "approval_id"),
    ).union(
        told(
            folded_grants,
            entry(used & (kind == "consume"), "authority.consumed", "authority_ref"),
            entry(used & (kind == "revoke"), "authority.revoked", "authority_ref"),
            entry(F.col("outcome") == "authority_expired", "authority.expired", "authority_ref"),
        )
    )


def journal_state(entries: DataFrame) -> DataFrame:
    """Latest mutation and state version of each object; at one seq the later type counts as later."""
    return entries.groupBy("object_id").agg(
        F.max_by("mutation", F.struct("seq", "mutation")).alias("last_mutation"), F.count(F.lit(1)).alias("state_version"), F.max("seq").alias("changed_at")
    )


def journal_counts(entries: DataFrame) -> DataFrame:
    """Mutations of each kind."""
    return entries.groupBy("mutation").agg(F.count(F.lit(1)).alias("n"))
