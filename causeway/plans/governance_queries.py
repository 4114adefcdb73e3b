"""Registered governance queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import authority
from ..operators import governance as g
from .calibration_queries import SQL_GAP, reference_assessment
from .derive import SQL_EVENTS, SQL_GOVERNANCE, approvals, decisions, grants, ledger_events

AT = "2001-12-31 00:00:00"
#: Order keys that share a pool of ids.
BLOCK = 500


def _at():
    return F.lit(AT).cast("timestamp")


def _rows(s, d):
    return g.timing(approvals(s, d), decisions(s, d), _at())


def _debt(s, d):
    return g.debt(_rows(s, d), g.stale_grants(grants(s, d), decisions(s, d), approvals(s, d), _at()))


def _metrics(s, d):
    return g.metrics(_rows(s, d), _debt(s, d), ledger_events(s, d))


def _signals(s, d):
    # one row each
    gap = g.horizon_gap(reference_assessment(s, d)).agg(F.max("autonomy_governance_gap").alias("autonomy_governance_gap"))
    m = _metrics(s, d).join(gap).select(
        "autonomy_governance_gap",
        F.col("effective_oversight_density").alias("effective_oversight_density_low"),
        F.col("oversight_debt").alias("oversight_debt_high"),
        F.col("p95_ms").alias("escalation_latency_p95_high"),
        F.col("n_explicit_breaches").alias("explicit_intervention_deadline_breach"),
        F.col("critical_coverage").alias("critical_oversight_coverage_low"),
    )
    return g.signals(m)


def _asked(s, d):
    """Every decision asks to resume with its grant; some with another's grant, another approval, action or target."""
    n = F.col("o_orderkey")
    return decisions(s, d).select(
        F.when(n % 17 == 0, F.concat(F.lit("approval:"), (n + 1).cast("string"))).otherwise(F.col("approval_id")).alias("approval_id"),
        F.when(n % 19 == 0, F.lit("decision:none")).otherwise(F.col("decision_id")).alias("decision_id"),
        F.concat(F.lit("auth:"), F.when(n % 23 == 0, n + 1).otherwise(n).cast("string")).alias("authority_ref"),
        F.when(n % 29 == 0, "N").otherwise("A").alias("action"),
        F.when(n % 31 == 0, "O").otherwise("F").alias("target"),
        F.when(n % 2 == 0, F.col("decided_at")).otherwise(_at()).alias("at"),
    )


def _fresh_grants(s, d):
    """Grants before any use; one in seven is revoked before."""
    n = F.col("o_orderkey")
    return grants(s, d).withColumns({"uses": F.when(n % 3 == 0, 1).otherwise(0), "state": F.when(n % 7 == 0, "revoked").otherwise("active")})


def _grant_commands(s, d):
    """Every line shipped is a use of its order's grant (action: return flag, target: line status) at its ship date; every
    eighth order's grant is revoked ten days after the decision. In order of time; ends of ties by what the use is."""
    li = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate")
    li = li.groupBy("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate").count()
    ref = F.concat(F.lit("auth:"), F.col("l_orderkey").cast("string"))
    uses = li.select(
        (F.unix_date(F.col("l_shipdate").cast("date")).cast("long") * 10_000_000 + F.col("l_partkey") * 6 + 2 * F.expr("case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end") + F.expr("if(l_linestatus = 'F', 0, 1)")).alias("seq"),
        ref.alias("authority_ref"), F.lit("consume").alias("kind"), F.col("l_returnflag").alias("action"), F.col("l_linestatus").alias("target"), F.col("l_shipdate").cast("timestamp").alias("at"),
    )
    day = F.unix_date((F.col("decided_at") + F.expr("interval 10 days")).cast("date")).cast("long")
    none = F.lit(None).cast("string")
    revoked = grants(s, d).where("o_orderkey % 8 = 0").select(
        (day * 10_000_000 + 9_999_999).alias("seq"), "authority_ref", F.lit("revoke"), none, none, F.col("decided_at") + F.expr("interval 10 days")
    )
    return uses.union(revoked)


def _approval_commands(s, d):
    """All requests, their decisions and expiries, with commands that must be refused among them.

    Before their own decision two thirds of the approvals try one from a pool of decision and grant ids that a block of
    orders shares, so whether an id is taken hangs on whether those before it were refused.
    """
    a, x = approvals(s, d), decisions(s, d)
    n, none = F.col("o_orderkey"), F.lit(None).cast("string")
    run = F.concat(F.lit("run:"), (n % 100).cast("string"))
    instant = F.lit(None).cast("timestamp")
    names = ["seq", "approval_id", "kind", "run_id", "expires_at", "decision_id", "decision", "at", "authority_ref", "grant_decision_id"]
    ref = F.when(F.col("decision").isin("approve", "modify") | (n % 41 == 0), F.concat(F.lit("auth:"), n.cast("string")))
    block = F.floor(n / BLOCK).cast("string")
    said = F.when(n % 47 == 0, F.concat(F.lit("decision:shared"), block)).otherwise(F.col("decision_id"))
    pooled = F.concat(F.lit("pool:"), block, F.lit(":"), (n * 7919 % 23).cast("string"))
    grant = F.when(F.col("decision").isin("approve", "modify"), F.concat(F.lit("pool:"), block, F.lit(":"), (n * 104729 % 19).cast("string")))

    def told(df, *commands):
        # requests and decisions are made once, with all their commands
        made = [F.when(cond, F.struct(*[v.alias(k) for k, v in zip(names, values, strict=True)])) for cond, *values in commands]
        return df.select(F.explode(F.array_compact(F.array(*made))).alias("c")).select("c.*")

    always, own, decision, decided = F.lit(True), F.col("approval_id"), F.col("decision"), F.col("decided_at")
    asked = (F.lit("enqueue"), run, F.col("expires_at"), none, none, instant, none, none)
    return told(
        a,
        (always, n * 10, own, *asked),
        (n % 37 == 0, n * 10 + 1, own, *asked),
        (always, n * 10 + 4, own, F.lit("expire"), none, instant, none, none, F.when(n % 4 == 0, F.col("requested_at")).otherwise(_at()), none, none),
    ).union(
        told(
            x,
            ((n % 3 != 0) & (n % 37 != 0), n * 10 + 1, own, F.lit("resolve"), run, instant, pooled, decision, decided, grant, F.when(grant.isNotNull(), pooled)),
            (always, n * 10 + 2, own, F.lit("resolve"), F.when(n % 43 == 0, "run:other").otherwise(run), instant, said, decision, decided, ref, F.when(n % 53 == 0, "decision:other").otherwise(said)),
            (n % 59 == 0, n * 10 + 3, F.concat(F.lit("approval:none"), n.cast("string")), F.lit("resolve"), run, instant, F.concat(F.lit("stray:"), "decision_id"), decision, decided, none, none),
            (n % 6 == 0, n * 10 + 5, own, F.lit("resolve"), run, instant, F.concat(F.lit("second:"), "decision_id"), decision, decided, none, none),
        )
    )


def _folded_grants(s, d):
    return g.fold_grants(_fresh_grants(s, d), _grant_commands(s, d))


def _journal(s, d):
    commands = _approval_commands(s, d)
    return g.journal(commands, g.fold_approvals(commands, "decision_id", "authority_ref"), _folded_grants(s, d))


def _logged(f, *kept):
    """f of the commands and their outcomes, with the commands' columns that f reads."""

    def query(s, d):
        commands = _approval_commands(s, d)
        return f(commands, g.fold_approvals(commands, *kept))

    return query


def _receipts(s, d):
    """Decisions, some given twice, some for an approval that no one asked for."""
    x, n = decisions(s, d), F.col("o_orderkey")
    stray = x.where("o_orderkey % 21 = 0").withColumn("approval_id", F.concat(F.lit("approval:none"), n.cast("string")))
    return x.union(x.where("o_orderkey % 18 = 0")).union(stray)


def _grant_rows(s, d):
    """Grants as they would be asked for, with planted faults."""
    n, stamp = F.col("o_orderkey"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return grants(s, d).select(
        "authority_ref", F.when(n % 9 != 0, F.col("decision_id")).alias("decision_id"), F.lit("principal").alias("principal"),
        F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("scope")).alias("scope"), "target",
        F.when(n % 8 == 0, "yesterday").otherwise(stamp(F.col("decided_at"))).alias("issued_at"), stamp(F.col("expires_at")).alias("expires_at"),
        F.when(n % 7 == 0, 0).otherwise(F.col("max_uses")).alias("max_uses"), F.when(n % 11 != 0, F.col("revocable")).alias("revocable"),
    )


def _stale(s, d):
    return g.stale_grants(grants(s, d), decisions(s, d), approvals(s, d), _at())


QUERIES = {
    "queue_pending": _logged(authority.pending, "run_id", "expires_at"),
    "queue_standing": _logged(lambda c, f: authority.standing(c, f).groupBy("status").agg(F.count(F.lit(1)).alias("n")), "run_id", "expires_at"),
    "queue_decisions": _logged(lambda c, f: authority.accepted_decisions(c, f).drop("at"), "decision_id", "decision", "at", "authority_ref"),
    "store_counts": lambda s, d: _logged(lambda c, f: authority.counts(c, f, g.journal(c, f, _folded_grants(s, d))), "decision_id", "authority_ref")(s, d),
    "receipt_faults": lambda s, d: authority.receipt_faults(approvals(s, d), _receipts(s, d)),
    "grant_makers": lambda s, d: authority.make_grants(_grant_rows(s, d))[1],
    "oversight_ids": lambda s, d: authority.id_lists(_rows(s, d), _stale(s, d)),
    "human_time": lambda s, d: authority.human_time(decisions(s, d)),
    "gov_timing": _rows,
    "gov_risk_coverage": lambda s, d: g.risk_coverage(_rows(s, d)),
    "gov_latency": lambda s, d: g.latency(_rows(s, d)),
    "gov_debt": _debt,
    "gov_metrics": _metrics,
    "gov_signals": _signals,
    "gov_overall_level": lambda s, d: g.overall_level(_signals(s, d)),
    "resume_eligibility": lambda s, d: g.resume_eligibility(_asked(s, d), approvals(s, d), decisions(s, d), grants(s, d)),
    "queue_expire": lambda s, d: g.expire_due(approvals(s, d), decisions(s, d), _at()),
    "queue_state": lambda s, d: g.fold_approvals(_approval_commands(s, d)),
    "authority_consumption": _folded_grants,
    "journal_state": lambda s, d: g.journal_state(_journal(s, d)),
    "journal_counts": lambda s, d: g.journal_counts(_journal(s, d)),
}

_ROWS = f"""{SQL_GOVERNANCE},
rows_a AS (SELECT a.approval_id, risk_class, CAST(CASE risk_class WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 4 ELSE 8 END AS DOUBLE) AS weight, decision,
  coalesce(explicit_deadline, expires_at) AS deadline_at, explicit_deadline IS NOT NULL AS explicit, requested_at, decided_at, human_governance_ms AS hg,
  coalesce(decision IN ('approve', 'deny', 'modify', 'cancel'), false) AS closing FROM approvals_v a LEFT JOIN decisions_v d USING (approval_id)),
rows_v AS (SELECT approval_id, risk_class, weight, decision, deadline_at, CASE WHEN explicit THEN 'explicit_intervention_deadline' ELSE 'approval_expiry' END AS deadline_basis,
  (epoch_us(decided_at) - epoch_us(requested_at)) // 1000 AS latency_ms,
  CAST((epoch_us(decided_at) - epoch_us(requested_at)) // 1000 AS DOUBLE) / CAST((epoch_us(deadline_at) - epoch_us(requested_at)) // 1000 AS DOUBLE) AS latency_ratio,
  (epoch_us(deadline_at) - epoch_us(decided_at)) // 1000 AS margin_ms, closing AND decided_at <= deadline_at AS is_effective, closing AS is_closed, NOT closing AS is_open,
  coalesce(decision = 'defer', false) AS is_deferred, NOT closing AND TIMESTAMP '{AT}' > deadline_at AS is_overdue,
  CASE WHEN NOT closing THEN (epoch_us(TIMESTAMP '{AT}') - epoch_us(requested_at)) // 1000 END AS open_age_ms,
  explicit AND CASE WHEN closing THEN NOT decided_at <= deadline_at ELSE TIMESTAMP '{AT}' > deadline_at END AS explicit_breach, hg AS human_governance_ms FROM rows_a),
stale_v AS (SELECT authority_ref, CAST(CASE risk_class WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 4 ELSE 8 END AS DOUBLE) AS weight
  FROM grants_v JOIN decisions_v USING (decision_id) JOIN approvals_v USING (approval_id) WHERE state = 'active' AND TIMESTAMP '{AT}' > grants_v.expires_at),
debt_v AS (SELECT component, n, w AS weight, w * m AS debt FROM (
  SELECT 'unresolved' AS component, count(*) AS n, coalesce(sum(weight), 0) AS w, 1.0::DOUBLE AS m FROM rows_v WHERE is_open
  UNION ALL SELECT 'overdue', count(*), coalesce(sum(weight), 0), 1.0 FROM rows_v WHERE is_overdue
  UNION ALL SELECT 'deferred', count(*), coalesce(sum(weight), 0), 0.5 FROM rows_v WHERE is_deferred
  UNION ALL SELECT 'stale_authority', count(*), coalesce(sum(weight), 0), 1.0 FROM stale_v)),
metrics_v AS (SELECT count(*) AS n_requests, count(decision) AS n_decisions, count(*) FILTER (is_effective) AS n_effective, count(*) FILTER (is_open) AS n_open,
  count(*) FILTER (is_overdue) AS n_overdue, count(*) FILTER (explicit_breach) AS n_explicit_breaches, sum(CASE WHEN is_effective THEN weight ELSE 0 END) / sum(weight) AS effective_oversight_density,
  count(*) FILTER (is_effective AND risk_class = 'critical') / CAST(nullif(count(*) FILTER (risk_class = 'critical'), 0) AS DOUBLE) AS critical_coverage,
  CAST(coalesce(sum(human_governance_ms), 0) AS BIGINT) AS human_governance_ms, quantile_disc(latency_ms, 0.95) AS p95_ms,
  (SELECT sum(debt) FROM debt_v) AS oversight_debt FROM rows_v)"""
_SIG = f"""{_ROWS}, {SQL_GAP}, signals_v AS (SELECT *, CASE WHEN observed IS NULL THEN 'not_applicable' WHEN comparator = '<=' AND observed <= threshold THEN 'clear'
  WHEN comparator = '>=' AND observed >= threshold THEN 'clear' ELSE 'breach' END AS status FROM (
  SELECT 'autonomy_governance_gap' AS code, autonomy_gap AS observed, 0.0::DOUBLE AS threshold, '<=' AS comparator, 'critical' AS severity, 'interaction_depth' AS unit FROM gap_v
  UNION ALL SELECT 'effective_oversight_density_low', effective_oversight_density, 0.5, '>=', 'high', 'ratio' FROM metrics_v
  UNION ALL SELECT 'oversight_debt_high', oversight_debt, 20, '<=', 'high', 'policy_weight' FROM metrics_v
  UNION ALL SELECT 'escalation_latency_p95_high', p95_ms, 1800000, '<=', 'medium', 'milliseconds' FROM metrics_v
  UNION ALL SELECT 'explicit_intervention_deadline_breach', n_explicit_breaches, 0, '<=', 'critical', 'count' FROM metrics_v
  UNION ALL SELECT 'critical_oversight_coverage_low', critical_coverage, 0.75, '>=', 'critical', 'ratio' FROM metrics_v))"""

#: Grants as a state machine, step by step: every command sees the state that the one before left.
_GRANTS = f"""{SQL_GOVERNANCE},
fresh_v AS (SELECT authority_ref, max_uses, expires_at, scope, target AS g_target, revocable, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS uses0, CASE WHEN o_orderkey % 7 = 0 THEN 'revoked' ELSE 'active' END AS state0 FROM grants_v),
cmd_v AS (SELECT DISTINCT CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 10000000 + l_partkey * 6 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS seq,
  'auth:' || l_orderkey AS authority_ref, 'consume' AS kind, l_returnflag AS action, l_linestatus AS target, l_shipdate AS instant FROM lineitem
  UNION ALL SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(decided_at + INTERVAL '10' DAY AS DATE)) AS BIGINT) * 10000000 + 9999999, authority_ref, 'revoke', NULL, NULL, decided_at + INTERVAL '10' DAY FROM grants_v WHERE o_orderkey % 8 = 0),
step_v AS (SELECT c.*, row_number() OVER (PARTITION BY authority_ref ORDER BY seq) AS i, f.* EXCLUDE (authority_ref) FROM cmd_v c LEFT JOIN fresh_v f USING (authority_ref)),
fold_v AS (SELECT 0 AS i, authority_ref, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS outcome, any_value(state0) AS state, any_value(uses0) AS uses FROM step_v GROUP BY authority_ref
  UNION ALL SELECT i, authority_ref, seq, kind, outcome, CASE WHEN outcome = 'accepted' AND kind = 'revoke' THEN 'revoked' WHEN outcome = 'authority_expired' THEN 'expired'
      WHEN outcome = 'accepted' AND uses + 1 >= max_uses THEN 'consumed' ELSE state END, CASE WHEN outcome = 'accepted' AND kind = 'consume' THEN uses + 1 ELSE uses END
  FROM (SELECT s.*, f.state, f.uses, CASE WHEN s.max_uses IS NULL THEN 'unknown_authority' WHEN s.kind = 'revoke' THEN CASE WHEN s.revocable THEN 'accepted' ELSE 'not_revocable' END
      WHEN f.state <> 'active' OR f.uses >= s.max_uses THEN 'authority_not_active' WHEN s.instant > s.expires_at THEN 'authority_expired' WHEN NOT list_contains(s.scope, s.action) THEN 'scope_mismatch'
      WHEN s.target <> s.g_target THEN 'target_mismatch' ELSE 'accepted' END AS outcome FROM fold_v f JOIN step_v s ON s.authority_ref = f.authority_ref AND s.i = f.i + 1))"""
#: Approvals as a state machine, step by step within a block of orders, whose ids no other block has.
_QUEUE = f"""{SQL_GOVERNANCE},
log_v AS (SELECT o_orderkey * 10 AS seq, approval_id, 'enqueue' AS kind, 'run:' || o_orderkey % 100 AS run, expires_at, NULL AS decision_id, NULL AS decision, NULL::TIMESTAMP AS instant, NULL AS ref, NULL AS gd FROM approvals_v
  UNION ALL SELECT o_orderkey * 10 + 1, approval_id, 'enqueue', 'run:' || o_orderkey % 100, expires_at, NULL, NULL, NULL, NULL, NULL FROM approvals_v WHERE o_orderkey % 37 = 0
  UNION ALL SELECT o_orderkey * 10 + 2, approval_id, 'resolve', CASE WHEN o_orderkey % 43 = 0 THEN 'run:other' ELSE 'run:' || o_orderkey % 100 END, NULL, CASE WHEN o_orderkey % 47 = 0 THEN 'decision:shared' || o_orderkey // {BLOCK} ELSE decision_id END, decision, decided_at,
    CASE WHEN decision IN ('approve', 'modify') OR o_orderkey % 41 = 0 THEN 'auth:' || o_orderkey END, CASE WHEN o_orderkey % 53 = 0 THEN 'decision:other' WHEN o_orderkey % 47 = 0 THEN 'decision:shared' || o_orderkey // {BLOCK} ELSE decision_id END FROM decisions_v
  UNION ALL SELECT o_orderkey * 10 + 1, approval_id, 'resolve', 'run:' || o_orderkey % 100, NULL, 'pool:' || o_orderkey // {BLOCK} || ':' || o_orderkey * 7919 % 23, decision, decided_at,
    CASE WHEN decision IN ('approve', 'modify') THEN 'pool:' || o_orderkey // {BLOCK} || ':' || o_orderkey * 104729 % 19 END, CASE WHEN decision IN ('approve', 'modify') THEN 'pool:' || o_orderkey // {BLOCK} || ':' || o_orderkey * 7919 % 23 END
    FROM decisions_v WHERE o_orderkey % 3 <> 0 AND o_orderkey % 37 <> 0
  UNION ALL SELECT o_orderkey * 10 + 3, 'approval:none' || o_orderkey, 'resolve', 'run:' || o_orderkey % 100, NULL, 'stray:' || decision_id, decision, decided_at, NULL, NULL FROM decisions_v WHERE o_orderkey % 59 = 0
  UNION ALL SELECT o_orderkey * 10 + 4, approval_id, 'expire', NULL, NULL, NULL, NULL, CASE WHEN o_orderkey % 4 = 0 THEN requested_at ELSE TIMESTAMP '{AT}' END, NULL, NULL FROM approvals_v
  UNION ALL SELECT o_orderkey * 10 + 5, approval_id, 'resolve', 'run:' || o_orderkey % 100, NULL, 'second:' || decision_id, decision, decided_at, NULL, NULL FROM decisions_v WHERE o_orderkey % 6 = 0),
flaw_v AS (SELECT l.*, a.expires_at AS due, a.o_orderkey AS k, CASE WHEN kind = 'resolve' THEN CASE WHEN run <> 'run:' || a.o_orderkey % 100 THEN 'run_mismatch' WHEN instant > a.expires_at THEN 'expired_before_decision'
    WHEN ref IS NOT NULL AND decision NOT IN ('approve', 'modify') THEN 'grant_not_allowed' WHEN ref IS NOT NULL AND gd <> decision_id THEN 'grant_decision_mismatch' END END AS flaw FROM log_v l LEFT JOIN approvals_v a USING (approval_id)),
cmds_v AS (SELECT *, seq // 10 // {BLOCK} AS blk, row_number() OVER (PARTITION BY seq // 10 // {BLOCK} ORDER BY seq) AS i FROM flaw_v),
queue_f AS (SELECT 0::BIGINT AS i, blk, NULL::BIGINT AS seq, NULL::VARCHAR AS approval_id, NULL::VARCHAR AS kind, NULL::VARCHAR AS decision_id, NULL::VARCHAR AS ref, NULL::VARCHAR AS outcome, NULL::VARCHAR AS status,
    NULL::VARCHAR AS cur, NULL::VARCHAR AS cur_status, []::VARCHAR[] AS ids, []::VARCHAR[] AS refs FROM cmds_v GROUP BY blk
  UNION ALL SELECT i, blk, seq, approval_id, kind, decision_id, ref, outcome, after, CASE WHEN after IS NULL THEN cur ELSE approval_id END, CASE WHEN after IS NULL THEN cur_status ELSE after END,
    CASE WHEN outcome = 'accepted' AND kind = 'resolve' THEN list_append(ids, decision_id) ELSE ids END, CASE WHEN outcome = 'accepted' AND kind = 'resolve' AND ref IS NOT NULL THEN list_append(refs, ref) ELSE refs END
  FROM (SELECT *, CASE WHEN kind = 'enqueue' AND st IS NULL THEN 'pending' WHEN outcome <> 'accepted' OR kind = 'enqueue' THEN st WHEN kind = 'expire' THEN 'expired' ELSE
      CASE decision WHEN 'approve' THEN 'approved' WHEN 'deny' THEN 'denied' WHEN 'modify' THEN 'modified' WHEN 'defer' THEN 'deferred' ELSE 'cancelled' END END AS after
    FROM (SELECT *, CASE WHEN kind = 'enqueue' THEN CASE WHEN st IS NULL THEN 'accepted' ELSE 'duplicate_approval_id' END WHEN st IS NULL THEN 'unknown_approval' WHEN st <> 'pending' THEN 'not_pending'
        WHEN kind = 'expire' THEN CASE WHEN instant >= due THEN 'accepted' ELSE 'not_due' END WHEN flaw IS NOT NULL THEN flaw WHEN list_contains(ids, decision_id) THEN 'duplicate_decision_id'
        WHEN ref IS NOT NULL AND list_contains(refs, ref) THEN 'duplicate_authority_ref' ELSE 'accepted' END AS outcome
      FROM (SELECT c.*, f.ids, f.refs, f.cur, f.cur_status, CASE WHEN f.cur = c.approval_id THEN f.cur_status END AS st FROM queue_f f JOIN cmds_v c ON c.blk = f.blk AND c.i = f.i + 1)))),
queue_v AS (SELECT seq, approval_id, kind, decision_id, ref, outcome, status FROM queue_f WHERE i > 0)"""
_JOURNAL = f"""{_QUEUE}, {_GRANTS.removeprefix(SQL_GOVERNANCE + ",")},
journal_v AS (SELECT seq, CASE kind WHEN 'enqueue' THEN 'approval.enqueued' WHEN 'resolve' THEN 'approval.resolved' ELSE 'approval.expired' END AS mutation, approval_id AS object_id FROM queue_v WHERE outcome = 'accepted'
  UNION ALL SELECT seq, 'decision.recorded', decision_id FROM queue_v WHERE outcome = 'accepted' AND kind = 'resolve' UNION ALL SELECT seq, 'authority.granted', ref FROM queue_v WHERE outcome = 'accepted' AND kind = 'resolve' AND ref IS NOT NULL
  UNION ALL SELECT seq, CASE kind WHEN 'consume' THEN 'authority.consumed' ELSE 'authority.revoked' END, authority_ref FROM fold_v WHERE outcome = 'accepted' UNION ALL SELECT seq, 'authority.expired', authority_ref FROM fold_v WHERE outcome = 'authority_expired')"""

_STANDING = f"""{_QUEUE}, standing_v AS (SELECT approval_id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status FROM queue_v GROUP BY approval_id),
taken_v AS (SELECT q.*, l.decision FROM queue_v q JOIN log_v l USING (seq) WHERE q.kind = 'resolve' AND outcome = 'accepted')"""

ORACLE = {
    "queue_pending": f"WITH RECURSIVE {_STANDING} SELECT approval_id, 'run:' || o_orderkey % 100 AS run_id, expires_at FROM standing_v JOIN approvals_v USING (approval_id) WHERE status = 'pending'",
    "queue_standing": f"WITH RECURSIVE {_STANDING} SELECT status, count(*) AS n FROM standing_v WHERE status IS NOT NULL GROUP BY status",
    "queue_decisions": f"WITH RECURSIVE {_STANDING} SELECT decision_id, approval_id, decision, ref AS authority_ref FROM taken_v",
    "store_counts": f"""WITH RECURSIVE {_JOURNAL}, {_STANDING.removeprefix(_QUEUE + ",")} SELECT 'approvals' AS name, count(*) AS n FROM standing_v WHERE status IS NOT NULL UNION ALL SELECT 'decisions', count(*) FROM taken_v
  UNION ALL SELECT 'grants', count(ref) FROM taken_v UNION ALL SELECT 'mutations', count(*) FROM journal_v""",
    "receipt_faults": f"""WITH {SQL_GOVERNANCE} SELECT 'approval:none' || o_orderkey AS approval_id, 'orphan_receipt' AS rule FROM decisions_v WHERE o_orderkey % 21 = 0
  UNION ALL SELECT approval_id, 'several_receipts' FROM decisions_v WHERE o_orderkey % 18 = 0""",
    "grant_makers": f"""WITH {SQL_GOVERNANCE} SELECT authority_ref, unnest(list_filter([CASE WHEN o_orderkey % 9 = 0 THEN 'decision_id_missing' END, CASE WHEN o_orderkey % 11 = 0 THEN 'revocable_missing' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'scope_empty' END, CASE WHEN o_orderkey % 7 = 0 THEN 'max_uses_too_small' END, CASE WHEN o_orderkey % 8 = 0 THEN 'issued_at_malformed' END], lambda x: x IS NOT NULL)) AS rule FROM grants_v""",
    "oversight_ids": f"""WITH {_ROWS} SELECT DISTINCT unnest(list_filter([CASE WHEN is_open THEN 'open' END, CASE WHEN is_overdue THEN 'overdue' END, CASE WHEN is_deferred THEN 'deferred' END, CASE WHEN explicit_breach THEN 'explicit_breach' END],
  lambda x: x IS NOT NULL)) AS list, approval_id AS id FROM rows_v UNION ALL SELECT 'stale_authority', authority_ref FROM stale_v""",
    "human_time": f"WITH {SQL_GOVERNANCE} SELECT count(*) AS n_receipts, CAST(sum(human_governance_ms) AS BIGINT) AS total_ms, avg(human_governance_ms) AS mean_ms FROM decisions_v",
    "gov_timing": f"WITH {_ROWS} SELECT * FROM rows_v",
    "gov_risk_coverage": f"""WITH {_ROWS}, k(risk_class, rw) AS (VALUES ('low', 1.0::DOUBLE), ('medium', 2.0), ('high', 4.0), ('critical', 8.0))
SELECT k.risk_class, count(approval_id) AS opportunities, count(*) FILTER (is_effective) AS effective, count(*) FILTER (is_closed) AS closed, count(*) FILTER (is_open) AS open,
  count(approval_id) * any_value(rw) AS weight_total, count(*) FILTER (is_effective) * any_value(rw) AS weight_effective,
  count(*) FILTER (is_effective) / CAST(nullif(count(approval_id), 0) AS DOUBLE) AS coverage FROM k LEFT JOIN rows_v USING (risk_class) GROUP BY k.risk_class""",
    "gov_latency": f"""WITH {_ROWS} SELECT count(*) AS n, avg(latency_ms) AS mean_ms, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms,
  max(latency_ms) AS max_ms FROM rows_v WHERE latency_ms IS NOT NULL""",
    "gov_debt": f"WITH {_ROWS} SELECT * FROM debt_v",
    "gov_metrics": f"""WITH {SQL_EVENTS}, {_ROWS} SELECT m.*, (SELECT count(*) FILTER (event_type = 'human.checkpoint.resolved') / CAST(count(*) FILTER (event_type <> 'tool.called') AS DOUBLE) FROM events_v)
  AS human_intervention_density FROM metrics_v m""",
    "gov_signals": f"WITH {_SIG} SELECT * FROM signals_v",
    "gov_overall_level": f"""WITH {_SIG}, w AS (SELECT arg_max(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) FILTER (status = 'breach') AS worst,
  count(*) FILTER (status = 'breach') AS n_breaches FROM signals_v)
SELECT coalesce(worst, 'clear') AS level, CASE coalesce(worst, 'clear') WHEN 'clear' THEN 'none' WHEN 'medium' THEN 'review' WHEN 'high' THEN 'priority_review' WHEN 'critical' THEN 'urgent_human_review'
  ELSE 'watch' END AS escalation, n_breaches FROM w""",
    "resume_eligibility": f"""WITH {SQL_GOVERNANCE}, asked_v AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'approval:' || (o_orderkey + 1) ELSE approval_id END AS approval_id, CASE WHEN o_orderkey % 19 = 0 THEN 'decision:none' ELSE decision_id END AS decision_id,
  'auth:' || CASE WHEN o_orderkey % 23 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS ref, CASE WHEN o_orderkey % 29 = 0 THEN 'N' ELSE 'A' END AS action, CASE WHEN o_orderkey % 31 = 0 THEN 'O' ELSE 'F' END AS want,
  CASE WHEN o_orderkey % 2 = 0 THEN decided_at ELSE TIMESTAMP '{AT}' END AS instant FROM decisions_v),
x AS (SELECT q.approval_id, q.decision_id, g.authority_ref, g.max_uses, g.uses, list_filter([CASE WHEN coalesce(d.decision, 'none') NOT IN ('approve', 'modify') THEN 'decision_not_authorizing' END,
  CASE WHEN g.authority_ref IS NULL THEN 'authority_missing' END, CASE WHEN state = 'revoked' THEN 'authority_revoked' END, CASE WHEN state <> 'revoked' AND (state = 'consumed' OR uses >= max_uses) THEN 'authority_exhausted' END,
  CASE WHEN q.instant > g.expires_at THEN 'authority_expired' END, CASE WHEN NOT list_contains(scope, q.action) THEN 'scope_mismatch' END, CASE WHEN want <> g.target THEN 'target_mismatch' END,
  CASE WHEN g.decision_id <> d.decision_id THEN 'decision_authority_mismatch' END, CASE WHEN g.authority_ref IS NOT NULL AND d.approval_id IS NOT NULL AND d.approval_id IS DISTINCT FROM a.approval_id THEN 'approval_decision_mismatch' END], lambda c: c IS NOT NULL) AS r
  FROM asked_v q LEFT JOIN approvals_v a USING (approval_id) LEFT JOIN decisions_v d ON d.decision_id = q.decision_id LEFT JOIN grants_v g ON g.authority_ref = q.ref)
SELECT approval_id, decision_id, authority_ref, len(r) = 0 AS eligible, array_to_string(r, ',') AS reasons, CASE WHEN authority_ref IS NOT NULL THEN greatest(0, max_uses - uses) ELSE 0 END AS remaining_uses FROM x""",
    "queue_expire": f"""WITH {SQL_GOVERNANCE} SELECT a.approval_id, CASE WHEN decision IS NULL AND TIMESTAMP '{AT}' >= a.expires_at THEN 'expired' WHEN decision IS NULL THEN 'pending'
  WHEN decided_at > a.expires_at THEN 'expired' WHEN decision = 'approve' THEN 'approved' WHEN decision = 'modify' THEN 'modified' WHEN decision = 'deny' THEN 'denied'
  WHEN decision = 'defer' THEN 'deferred' ELSE 'cancelled' END AS status FROM approvals_v a LEFT JOIN decisions_v d USING (approval_id)""",
    "queue_state": f"WITH RECURSIVE {_QUEUE} SELECT seq, approval_id, kind, outcome, status FROM queue_v",
    "authority_consumption": f"""WITH RECURSIVE {_GRANTS} SELECT seq, authority_ref, kind, outcome, state, CAST(uses AS BIGINT) AS uses FROM fold_v WHERE i > 0""",
    "journal_state": f"""WITH RECURSIVE {_JOURNAL} SELECT object_id, arg_max(mutation, (seq, mutation)) AS last_mutation, count(*) AS state_version, max(seq) AS changed_at FROM journal_v GROUP BY object_id""",
    "journal_counts": f"""WITH RECURSIVE {_JOURNAL} SELECT mutation, count(*) AS n FROM journal_v GROUP BY mutation""",
}
