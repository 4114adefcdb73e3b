"""Ledger-shaped views of the driver's tables, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tag(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each user; parents repeat the diamond 1 -> {2, 3} -> 4 -> 5 -> {6, 7} -> 8."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    kinds = {"click": "action.completed", "view": "tool.called", "purchase": "commit.confirmed", "signup": "human.checkpoint.resolved"}
    actors = {"click": "agent", "view": "tool", "purchase": "external_system", "signup": "human"}

    def named(names: dict[str, str], other: str):
        out = F.lit(other)
        for k, v in names.items():
            out = F.when(F.col("event_type") == k, v).otherwise(out)
        return out

    s = F.col("ledger_seq")
    parents = (
        F.when(s == 1, F.array().cast("array<bigint>"))
        .when(s % 4 == 3, F.array(s - 2))
        .when(s % 4 == 0, F.array(s - 2, s - 1))
        .otherwise(F.array(s - 1))
    )
    return e.select(
        _tag("run:", "user_id").alias("run_id"),
        seq.alias("ledger_seq"),
        _tag("evt_", "event_id").alias("event_id"),
        named(kinds, "validation.completed").alias("event_type"),
        named(actors, "validator").alias("actor_type"),
        F.round(F.col("value") * 100).cast("double").alias("machine_runtime_ms"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
    ).withColumn("parent_seqs", parents)


SQL_EVENTS = """
events_v AS (SELECT concat('run:', CAST(user_id AS VARCHAR)) AS run_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS ledger_seq,
  concat('evt_', CAST(event_id AS VARCHAR)) AS event_id,
  CASE event_type WHEN 'click' THEN 'action.completed' WHEN 'view' THEN 'tool.called' WHEN 'purchase' THEN 'commit.confirmed'
    WHEN 'signup' THEN 'human.checkpoint.resolved' ELSE 'validation.completed' END AS event_type,
  CASE event_type WHEN 'click' THEN 'agent' WHEN 'view' THEN 'tool' WHEN 'purchase' THEN 'external_system'
    WHEN 'signup' THEN 'human' ELSE 'validator' END AS actor_type,
  CAST(round(value * 100) AS DOUBLE) AS machine_runtime_ms, ts AS occurred_at FROM events),
edges_v AS (SELECT e.run_id, e.ledger_seq AS child_seq,
  e.ledger_seq - (CASE WHEN e.ledger_seq % 4 = 3 THEN 2 WHEN e.ledger_seq % 4 = 0 THEN k.k ELSE 1 END) AS parent_seq
  FROM events_v e JOIN (SELECT 1 AS k UNION ALL SELECT 2) k ON (k.k = 1 OR e.ledger_seq % 4 = 0) WHERE e.ledger_seq > 1)"""


def artifact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with artifacts: tool calls and actions make one each, from those that their parents made."""
    e = ledger_events(spark, sf_dir)
    makes = F.col("event_type").isin("tool.called", "action.completed")
    made = e.where(makes).select("run_id", F.col("ledger_seq").alias("parent"), F.concat(F.lit("art:"), "event_id").alias("ref"))
    read = (
        e.select("run_id", "ledger_seq", F.explode("parent_seqs").alias("parent")).join(made, ["run_id", "parent"])
        .groupBy("run_id", "ledger_seq").agg(F.collect_set("ref").alias("input_refs"))
    )
    made_here = F.when(makes, F.array(F.concat(F.lit("art:"), "event_id")))
    return e.join(read, ["run_id", "ledger_seq"], "left").withColumn("output_refs", made_here)


def traced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with actors, tokens, branches, joins, statuses and given trace ids, each missing in some events."""
    e, s = ledger_events(spark, sf_dir), F.col("ledger_seq")
    n = F.regexp_extract("event_id", r"(\d+)", 1).cast("long")
    words = F.array(*map(F.lit, ("OK", "Failed", "denied", "confirmed", "running")))
    return e.withColumns(
        {
            "actor_id": F.when(n % 7 == 0, "").when(n % 5 != 0, F.concat("actor_type", F.lit(":"), (n % 3).cast("string"))),
            "status": F.when(n % 6 != 0, F.element_at(words, (n % 5 + 1).cast("int"))),
            "branch_id": F.when(s % 4 == 2, F.concat(F.lit("branch:"), s.cast("string"))),
            "join_semantics": F.when(s % 4 == 0, "all"),
            "join_quorum": F.when(s % 8 == 0, 2),
            "token_in": F.when(F.col("actor_type") == "agent", n % 1000),
            "token_out": F.when((F.col("actor_type") == "agent") & (n % 2 == 0), n % 100),
            "trace_id": F.when(n % 9 == 0, F.upper(F.md5("run_id"))).when(n % 9 == 1, "short"),
            "span_id": F.when(n % 10 == 0, F.substring(F.upper(F.md5("event_id")), 1, 16)),
        }
    )


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second ledger: run = conversation, record = the text of a turn."""
    c = table(spark, sf_dir, "conversations")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return c.select(
        _tag("run:", "conv_id").alias("run_id"),
        seq.alias("ledger_seq"),
        F.concat(F.lit("evt_"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("event_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("record"),
        "role",
    )


SQL_RECORDS = """
records_v AS (SELECT concat('run:', CAST(conv_id AS VARCHAR)) AS run_id,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS ledger_seq,
  concat('evt_', CAST(conv_id AS VARCHAR), '.', CAST(turn AS VARCHAR)) AS event_id,
  encode(coalesce(text, '')) AS record, role FROM conversations)"""


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("d"))
    risk = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
        .otherwise("low")
    )
    return o.select(
        _tag("approval:", "o_orderkey").alias("approval_id"),
        risk.alias("risk_class"),
        F.col("d").alias("requested_at"),
        (F.col("d") + F.expr("interval 365 days")).alias("expires_at"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("d") + F.expr("interval 180 days")).alias("explicit_deadline"),
        "o_orderkey",
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    shipped = (
        o.join(li, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")))
        .groupBy("o_orderkey")
        .agg(
            F.min("l_shipdate").cast("timestamp").alias("decided_at"),
            (F.sum("l_quantity").cast("long") * 1000).alias("human_governance_ms"),
            F.count(F.lit(1)).alias("line_count"),
        )
    )
    m = F.col("o_orderkey") % 10
    decision = F.when(m < 5, "approve").when(m < 7, "deny").when(m == 7, "modify").when(m == 8, "defer").otherwise("cancel")
    return shipped.select(
        _tag("decision:", "o_orderkey").alias("decision_id"),
        _tag("approval:", "o_orderkey").alias("approval_id"),
        decision.alias("decision"),
        "decided_at",
        "human_governance_ms",
        "line_count",
        "o_orderkey",
    )


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = 1 + F.col("o_orderkey") % 3
    return (
        decisions(spark, sf_dir)
        .where(F.col("decision").isin("approve", "modify"))
        .select(
            _tag("auth:", "o_orderkey").alias("authority_ref"),
            "decision_id",
            (F.col("decided_at") + F.expr("interval 30 days")).alias("expires_at"),
            cap.alias("max_uses"),
            F.least(F.col("line_count"), cap).alias("uses"),
            F.when(F.col("line_count") >= cap, "consumed").when(F.col("o_orderkey") % 7 == 0, "revoked").otherwise("active").alias("state"),
            F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("N"))).alias("scope"),
            F.when(F.col("o_orderkey") % 13 == 0, "O").otherwise("F").alias("target"),
            (F.col("o_orderkey") % 5 != 0).alias("revocable"),
            "decided_at",
            "o_orderkey",
        )
    )


SQL_GOVERNANCE = """
approvals_v AS (SELECT concat('approval:', CAST(o_orderkey AS VARCHAR)) AS approval_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS risk_class,
  o_orderdate AS requested_at, o_orderdate + INTERVAL '365' DAY AS expires_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '180' DAY END AS explicit_deadline, o_orderkey FROM orders),
decisions_v AS (SELECT concat('decision:', CAST(o_orderkey AS VARCHAR)) AS decision_id, concat('approval:', CAST(o_orderkey AS VARCHAR)) AS approval_id,
  CASE WHEN o_orderkey % 10 < 5 THEN 'approve' WHEN o_orderkey % 10 < 7 THEN 'deny' WHEN o_orderkey % 10 = 7 THEN 'modify'
       WHEN o_orderkey % 10 = 8 THEN 'defer' ELSE 'cancel' END AS decision,
  min(l_shipdate) AS decided_at, CAST(sum(l_quantity) AS BIGINT) * 1000 AS human_governance_ms, count(*) AS line_count, o_orderkey
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate GROUP BY o_orderkey),
grants_v AS (SELECT concat('auth:', CAST(o_orderkey AS VARCHAR)) AS authority_ref, decision_id, decided_at + INTERVAL '30' DAY AS expires_at,
  1 + o_orderkey % 3 AS max_uses, least(line_count, 1 + o_orderkey % 3) AS uses,
  CASE WHEN line_count >= 1 + o_orderkey % 3 THEN 'consumed' WHEN o_orderkey % 7 = 0 THEN 'revoked' ELSE 'active' END AS state,
  CASE WHEN o_orderkey % 11 = 0 THEN ['A'] ELSE ['A', 'N'] END AS scope, CASE WHEN o_orderkey % 13 = 0 THEN 'O' ELSE 'F' END AS target, o_orderkey % 5 <> 0 AS revocable, decided_at, o_orderkey
  FROM decisions_v WHERE decision IN ('approve', 'modify'))"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success curves of 2 snapshots, 3 families and 2 subjects, from all lines.

    A trial is a supplier with its lines of one snapshot, family and depth (quantity in fives, at most 7 for R); it
    succeeds if their mean load is within the limit. Loads and limits are whole hundredths, so sums are exact.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_linestatus", "l_returnflag", "l_quantity", "l_discount", "l_tax"
    )
    flag, first = F.col("l_returnflag"), F.col("l_linestatus") == "F"
    limit = F.when(flag == "A", 100).when(flag == "N", 125).otherwise(90) + F.when(first, 0).when(flag == "N", 2).when(flag == "A", 8).otherwise(-6)
    depth = F.ceil(F.col("l_quantity") / 5).cast("long")
    # both subjects have the same lines: they part only when lines are counted
    extra = {"autonomy": F.round(F.col("l_discount") * 100) * 5, "governance": F.round(F.col("l_tax") * 100) * 7}
    per_supplier = li.groupBy(
        F.when(first, "base").otherwise("current").alias("snapshot_id"),
        flag.alias("family_id"),
        F.when(flag == "R", F.least(depth, F.lit(7).cast("long"))).otherwise(depth).alias("depth"),
        "l_suppkey",
    ).agg(*[(F.sum((F.round(F.col("l_quantity") * 2) + x - limit).cast("long")) <= 0).alias(name) for name, x in extra.items()])
    counted = per_supplier.groupBy("snapshot_id", "family_id", "depth").agg(
        F.count(F.lit(1)).alias("trials"), *[F.count_if(name).alias(name) for name in extra]
    )
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("subject"), F.col(name).alias("successes")) for name in extra])).alias("s")
    return counted.select("snapshot_id", "family_id", "depth", "trials", each).select("snapshot_id", "family_id", "s.subject", "depth", "trials", "s.successes")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two snapshots of trials(), with their families: base is seen when its first line ships, current when its last does."""
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", "l_shipdate")
    return li.groupBy(F.when(F.col("l_linestatus") == "F", "base").otherwise("current").alias("snapshot_id")).agg(
        F.when(F.min("l_linestatus") == "F", F.min("l_shipdate")).otherwise(F.max("l_shipdate")).cast("timestamp").alias("observed_at"),
        F.lit("backend:1").alias("backend_id"),
        F.lit("1").alias("benchmark_version"),
        F.concat(F.lit("config:"), F.min("l_linestatus")).alias("agent_config_id"),
        F.sort_array(F.collect_set("l_returnflag")).alias("families"),
    )


SQL_SNAPSHOTS = """
snapshots_v AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'base' ELSE 'current' END AS snapshot_id, CASE WHEN min(l_linestatus) = 'F' THEN min(l_shipdate) ELSE max(l_shipdate) END AS observed_at, 'config:' || min(l_linestatus) AS config,
  list_sort(list(DISTINCT l_returnflag)) AS families FROM lineitem GROUP BY 1),
context_v AS (SELECT b.config <> c.config AS config_changed, b.families <> c.families AS families_changed, (epoch_us(c.observed_at) - epoch_us(b.observed_at)) / 86400000000.0::DOUBLE AS days
  FROM snapshots_v b JOIN snapshots_v c ON b.snapshot_id = 'base' AND c.snapshot_id = 'current')"""

SQL_TRIALS = """
lines_v AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'base' ELSE 'current' END AS snapshot_id, l_returnflag AS family_id, s.subject,
  CAST(CASE WHEN l_returnflag = 'R' THEN least(ceil(l_quantity / 5), 7) ELSE ceil(l_quantity / 5) END AS BIGINT) AS depth, l_suppkey,
  CAST(round(l_quantity * 2) + (CASE WHEN s.subject = 'autonomy' THEN round(l_discount * 100) * 5 ELSE round(l_tax * 100) * 7 END)
    - (CASE l_returnflag WHEN 'A' THEN 100 WHEN 'N' THEN 125 ELSE 90 END)
    - (CASE WHEN l_linestatus = 'F' THEN 0 WHEN l_returnflag = 'N' THEN 2 WHEN l_returnflag = 'A' THEN 8 ELSE -6 END) AS BIGINT) AS over
  FROM lineitem CROSS JOIN (SELECT 'autonomy' AS subject UNION ALL SELECT 'governance') s),
trials_v AS (SELECT snapshot_id, family_id, subject, depth, count(*) AS trials, count(*) FILTER (over <= 0) AS successes
  FROM (SELECT snapshot_id, family_id, subject, depth, l_suppkey, sum(over) AS over FROM lines_v GROUP BY ALL) GROUP BY ALL)"""
