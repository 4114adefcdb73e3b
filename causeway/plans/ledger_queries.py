"""Registered ledger, topology, integrity and projection queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity, interop, ledger, topology, validation, witness
from .derive import SQL_EVENTS, SQL_RECORDS, artifact_events, chat_records, ledger_events, traced_events

PREFIX, SCHEMA_URI = "org.example.ledger", "https://example.org/schemas/event.json"


def faulty_events(spark, sf_dir):
    """The ledger with planted faults: an unknown parent, a self-parent, a repeated place and a repeated id."""
    e = ledger_events(spark, sf_dir)
    s, n = F.col("ledger_seq"), F.regexp_extract("event_id", r"(\d+)", 1).cast("long")
    parents = (
        F.when(n % 97 == 0, F.array(s + 100000)).when(n % 89 == 0, F.array(s)).otherwise(F.col("parent_seqs"))
    )
    return e.withColumns(
        {
            "parent_seqs": parents,
            "event_id": F.when((n % 83 == 0) & (s > 1), F.concat(F.lit("evt_twice_"), "run_id")).otherwise(F.col("event_id")),
        }
    )


def _tampered(spark, sf_dir):
    """Records, sidecar and anchor, most runs changed at one place after sealing."""
    records = chat_records(spark, sf_dir).drop("role")
    side = integrity.seal(records)
    anchor = integrity.anchors(side)
    n = F.regexp_extract("run_id", r"(\d+)", 1).cast("long") % 16
    first, seq, none = F.col("ledger_seq") == 1, F.col("ledger_seq"), F.lit(None).cast("string")
    profile = {"hash_algorithm": F.lit("sha256"), "record_encoding": F.lit("exact-bytes")}
    records = records.withColumns(
        {
            "position": seq,
            "is_sound": ~((n == 14) & (seq == 2)),
            "record": F.when((n == 1) & first, F.lit("changed").cast("binary")).otherwise(F.col("record")),
            "ledger_seq": F.when((n == 13) & (seq == 2), seq + 1).otherwise(seq),
        }
    ).where(n != 12)
    side = side.withColumns(
        {
            **profile,
            "previous_chain_digest": F.when((n == 2) & first, F.lit("sha256:" + "f" * 64)).otherwise(F.col("previous_chain_digest")),
            "chain_digest": F.when((n == 5) & first, none).otherwise(F.col("chain_digest")),
            "record_digest": F.when((n == 6) & (seq == 2), none).otherwise(F.col("record_digest")),
            "event_id": F.when((n == 7) & (seq == 2), none).otherwise(F.col("event_id")),
        }
    ).withColumn("hash_algorithm", F.when((n == 8) & first, F.lit("md5")).otherwise(F.col("hash_algorithm")))
    side = side.where(~((n == 3) & first)).withColumn("position", seq)
    anchor = anchor.withColumns(
        {
            **profile,
            "event_count": F.when(n == 4, F.col("event_count") + 1).otherwise(F.col("event_count")),
            "final_chain_digest": F.when(n == 9, none).otherwise(F.col("final_chain_digest")),
            "first_event_id": F.when(n == 11, none).otherwise(F.col("first_event_id")),
        }
    ).where(n != 10)
    return records, side, anchor


def _checks(spark, sf_dir):
    """Structural rules on events with planted faults: malformed ids and types, missing actors, negative run times."""
    n = F.regexp_extract("event_id", r"(\d+)", 1).cast("long")
    e = ledger_events(spark, sf_dir).select(
        n.alias("n"),
        F.when(n % 31 == 0, F.concat(F.lit("bad "), "event_id")).otherwise(F.col("event_id")).alias("event_id"),
        F.when(n % 37 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(n % 41 != 0, F.col("actor_type")).alias("actor_type"),
        F.when(n % 43 == 0, F.lit(-1.0)).otherwise(F.col("machine_runtime_ms")).alias("machine_runtime_ms"),
    )
    rules = [
        validation.pattern("event_id", validation.EVENT_ID),
        validation.pattern("event_type", validation.EVENT_TYPE),
        validation.required("actor_type"),
        validation.one_of("actor_type", ["agent", "tool", "external_system", "human"]),
        validation.at_least("machine_runtime_ms", 0),
    ]
    return validation.check(e, "n", rules)


def _witnessed(spark, sf_dir):
    """Anchors against witness records of which some are absent, unsigned or of another digest."""
    anchors = integrity.anchors(integrity.seal(chat_records(spark, sf_dir)))
    n = F.regexp_extract("run_id", r"(\d+)", 1).cast("long")
    seen = anchors.where(n % 4 != 3).select(
        "run_id",
        F.concat(F.lit("instant:"), "run_id").alias("instant_id"),
        F.when(n % 4 == 1, F.lit("other")).otherwise(F.col("final_chain_digest")).alias("digest"),
        F.when(n % 4 != 2, F.lit("signature")).alias("signature"),
    )
    return witness.match(anchors, seen)


def _attempts(s, d):
    """Attempts are the diamonds of four events; every fifth event belongs to none."""
    at = F.when(F.col("ledger_seq") % 5 != 0, F.concat(F.lit("attempt:"), F.floor((F.col("ledger_seq") - 1) / 4).cast("string")))
    return ledger.attempts(ledger_events(s, d).withColumn("attempt_id", at))


QUERIES = {
    "event_checks": _checks,
    "witness_match": _witnessed,
    "ledger_validate": lambda s, d: topology.violations(faulty_events(s, d)),
    "ledger_edges": lambda s, d: topology.edges(ledger_events(s, d)),
    "topology_nodes": lambda s, d: topology.nodes(ledger_events(s, d)),
    "topology_summary": lambda s, d: topology.summary(ledger_events(s, d)),
    "critical_path": lambda s, d: topology.critical_path(ledger_events(s, d)),
    "reachability": lambda s, d: topology.reachability(ledger_events(s, d)),
    "poset_width": lambda s, d: topology.width(ledger_events(s, d)),
    "integrity_chain": lambda s, d: integrity.seal(chat_records(s, d)),
    "integrity_anchor": lambda s, d: integrity.anchors(integrity.seal(chat_records(s, d))),
    "integrity_verify": lambda s, d: integrity.verify(*_tampered(s, d)),
    "cloudevents": lambda s, d: interop.to_cloudevents(ledger_events(s, d), PREFIX, SCHEMA_URI),
    "cloudevents_roundtrip": lambda s, d: interop.from_cloudevents(interop.to_cloudevents(ledger_events(s, d), PREFIX, SCHEMA_URI)),
    "otel_spans": lambda s, d: interop.spans(ledger_events(s, d)),
    "otel_links": lambda s, d: interop.links(ledger_events(s, d)),
    "otel_attributes": lambda s, d: interop.attributes(ledger_events(s, d)),
    "run_summary": lambda s, d: ledger.run_summary(ledger_events(s, d)),
    "budget_usage": lambda s, d: ledger.budget_usage(ledger_events(s, d)),
    "delegation_span": lambda s, d: ledger.delegation_spans(ledger_events(s, d)),
    "replay_state": lambda s, d: ledger.replay_state(ledger_events(s, d)),
    "causal_neighbours": lambda s, d: ledger.neighbours(ledger_events(s, d)),
    "false_completions": lambda s, d: ledger.false_completions(ledger_events(s, d)),
    "otel_traced_spans": lambda s, d: interop.spans(traced_events(s, d)),
    "otel_traced_attributes": lambda s, d: interop.attributes(traced_events(s, d)),
    "artifact_lineage": lambda s, d: ledger.artifact_lineage(artifact_events(s, d)),
    "ledger_attempts": _attempts,
    "human_checkpoints": lambda s, d: ledger.human_checkpoints(ledger_events(s, d)),
    "witness_requests": lambda s, d: witness.requests(integrity.anchors(integrity.seal(chat_records(s, d)))),
}

_DEPTH = """
adj AS (SELECT e.run_id, e.ledger_seq, any_value(e.machine_runtime_ms) AS w, list(g.parent_seq) FILTER (g.parent_seq IS NOT NULL) AS ps
  FROM events_v e LEFT JOIN edges_v g ON g.run_id = e.run_id AND g.child_seq = e.ledger_seq GROUP BY ALL),
"""
_CHAIN = """
digests AS (SELECT run_id, ledger_seq, event_id, sha256(record) AS d FROM records_v),
chain AS (SELECT run_id, ledger_seq, event_id, d, repeat('0', 64) AS prev,
    sha256(encode('causeway/chain/v1') || unhex('00') || unhex(repeat('0', 64)) || unhex(d)) AS cur FROM digests WHERE ledger_seq = 1
  UNION ALL SELECT n.run_id, n.ledger_seq, n.event_id, n.d, c.cur,
    sha256(encode('causeway/chain/v1') || unhex('00') || unhex(c.cur) || unhex(n.d))
  FROM chain c JOIN digests n ON n.run_id = c.run_id AND n.ledger_seq = c.ledger_seq + 1)
"""
_OP = "CASE WHEN event_type LIKE 'plan.%' THEN 'plan' WHEN event_type LIKE 'tool.%' OR actor_type = 'tool' THEN 'execute_tool' WHEN actor_type IN ('agent', 'subagent') THEN 'invoke_agent' END"
_EFF = "event_type IN ('action.completed', 'validation.completed', 'commit.confirmed', 'human.checkpoint.resolved')"

_TRACED = """
n_v AS (SELECT *, CAST(regexp_extract(event_id, '(\\d+)', 1) AS BIGINT) AS n FROM events_v),
traced_v AS (SELECT *, CASE WHEN n % 7 = 0 THEN '' WHEN n % 5 <> 0 THEN actor_type || ':' || n % 3 END AS actor_id, CASE WHEN n % 6 <> 0 THEN ['OK', 'Failed', 'denied', 'confirmed', 'running'][n % 5 + 1] END AS word,
  CASE WHEN ledger_seq % 4 = 2 THEN 'branch:' || ledger_seq END AS branch, CASE WHEN ledger_seq % 4 = 0 THEN 'all' END AS how, CASE WHEN ledger_seq % 8 = 0 THEN '2' END AS quorum,
  CASE WHEN actor_type = 'agent' THEN CAST(n % 1000 AS VARCHAR) END AS tin, CASE WHEN actor_type = 'agent' AND n % 2 = 0 THEN CAST(n % 100 AS VARCHAR) END AS tout,
  CASE WHEN n % 9 = 0 THEN md5(run_id) ELSE sha256(run_id)[1:32] END AS trace, CASE WHEN n % 10 = 0 THEN md5(event_id)[1:16] ELSE sha256(event_id)[1:16] END AS span,
  """ + _OP + """ AS op FROM n_v),
parents_v AS (SELECT run_id, child_seq, count(*) AS k, min(parent_seq) AS ps FROM edges_v GROUP BY ALL)"""

ORACLE = {
    "event_checks": f"""WITH {SQL_EVENTS}, x AS (SELECT CAST(regexp_extract(event_id, '(\\d+)', 1) AS BIGINT) AS n, actor_type, machine_runtime_ms AS ms FROM events_v)
SELECT n, 'event_id_malformed' AS rule FROM x WHERE n % 31 = 0 UNION ALL SELECT n, 'event_type_malformed' FROM x WHERE n % 37 = 0 UNION ALL SELECT n, 'actor_type_missing' FROM x WHERE n % 41 = 0
UNION ALL SELECT n, 'actor_type_unknown' FROM x WHERE n % 41 <> 0 AND actor_type = 'validator' UNION ALL SELECT n, 'machine_runtime_ms_too_small' FROM x WHERE n % 43 = 0 OR ms < 0""",
    "witness_match": f"""WITH RECURSIVE {SQL_RECORDS}, {_CHAIN}, a AS (SELECT run_id, 'sha256:' || arg_max(cur, ledger_seq) AS h, CAST(regexp_extract(run_id, '(\\d+)', 1) AS BIGINT) % 4 AS m FROM chain GROUP BY run_id),
w AS (SELECT run_id, CASE m WHEN 1 THEN 'other' ELSE h END AS digest, CASE WHEN m <> 2 THEN 'signature' END AS sig FROM a WHERE m <> 3)
SELECT a.run_id, CASE WHEN w.run_id IS NULL THEN 'missing_instant_id' WHEN digest IS DISTINCT FROM h THEN 'digest_mismatch' WHEN sig IS NULL THEN 'unsigned' END AS code FROM a LEFT JOIN w USING (run_id)""",
    "ledger_validate": f"""WITH {SQL_EVENTS},
f AS (SELECT *, CAST(regexp_extract(event_id, '(\\d+)', 1) AS BIGINT) AS n FROM events_v),
x AS (SELECT run_id, ledger_seq, CASE WHEN n % 83 = 0 AND ledger_seq > 1 THEN 'evt_twice_' || run_id ELSE event_id END AS event_id, n FROM f),
g AS (SELECT run_id, ledger_seq AS child_seq, CASE WHEN n % 97 = 0 THEN ledger_seq + 100000 ELSE ledger_seq END AS parent_seq FROM x WHERE n % 97 = 0 OR n % 89 = 0
  UNION ALL SELECT e.run_id, e.child_seq, e.parent_seq FROM edges_v e JOIN x ON x.run_id = e.run_id AND x.ledger_seq = e.child_seq WHERE n % 97 <> 0 AND n % 89 <> 0)
SELECT DISTINCT * FROM (
  SELECT run_id, ledger_seq, 'duplicate_ledger_seq' AS rule FROM x GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT run_id, min(ledger_seq), 'duplicate_event_id' FROM x GROUP BY run_id, event_id HAVING count(*) > 1
  UNION ALL SELECT run_id, child_seq, 'self_parent' FROM g WHERE parent_seq = child_seq
  UNION ALL SELECT run_id, child_seq, 'parent_not_before' FROM g WHERE parent_seq > child_seq
  UNION ALL SELECT g.run_id, child_seq, 'unknown_parent' FROM g ANTI JOIN x ON x.run_id = g.run_id AND x.ledger_seq = g.parent_seq)""",
    "ledger_edges": f"WITH {SQL_EVENTS} SELECT run_id, parent_seq, child_seq FROM edges_v",
    "topology_nodes": f"""WITH {SQL_EVENTS},
i AS (SELECT run_id, child_seq AS s, count(*) AS n FROM edges_v GROUP BY ALL), o AS (SELECT run_id, parent_seq AS s, count(*) AS n FROM edges_v GROUP BY ALL)
SELECT e.run_id, e.ledger_seq, e.event_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) = 0 AS is_root,
  coalesce(o.n, 0) = 0 AS is_leaf, coalesce(o.n, 0) > 1 AS is_branch, coalesce(i.n, 0) > 1 AS is_join
FROM events_v e LEFT JOIN i ON i.run_id = e.run_id AND i.s = e.ledger_seq LEFT JOIN o ON o.run_id = e.run_id AND o.s = e.ledger_seq""",
    "otel_traced_spans": f"""WITH {SQL_EVENTS}, {_TRACED}
SELECT e.event_id, CASE WHEN e.op <> 'plan' AND e.actor_id <> '' THEN e.op || ' ' || e.actor_id ELSE coalesce(e.op, e.event_type) END AS name, 'INTERNAL' AS span_kind, e.trace AS trace_id, e.span AS span_id,
  CASE WHEN p.k = 1 THEN q.span END AS parent_span_id, e.op AS operation, CASE lower(e.word) WHEN 'failed' THEN 'ERROR' WHEN 'denied' THEN 'ERROR' WHEN 'ok' THEN 'OK' WHEN 'confirmed' THEN 'OK' ELSE 'UNSET' END AS status, coalesce(p.k, 0) AS parent_count
FROM traced_v e LEFT JOIN parents_v p ON p.run_id = e.run_id AND p.child_seq = e.ledger_seq LEFT JOIN traced_v q ON q.run_id = e.run_id AND q.ledger_seq = p.ps""",
    "otel_traced_attributes": f"""WITH {SQL_EVENTS}, {_TRACED}, b AS (SELECT e.*, CAST(coalesce(p.k, 0) AS VARCHAR) AS k FROM traced_v e LEFT JOIN parents_v p ON p.run_id = e.run_id AND p.child_seq = e.ledger_seq),
m AS (SELECT event_id, unnest([{{'key': 'event.id', 'value': event_id}}, {{'key': 'event.type', 'value': event_type}}, {{'key': 'run.id', 'value': run_id}}, {{'key': 'ledger.seq', 'value': CAST(ledger_seq AS VARCHAR)}},
  {{'key': 'causal.parent.count', 'value': k}}, {{'key': 'actor.type', 'value': actor_type}}, {{'key': 'gen_ai.operation.name', 'value': op}}, {{'key': 'actor.id', 'value': actor_id}}, {{'key': 'branch.id', 'value': branch}},
  {{'key': 'join.semantics', 'value': how}}, {{'key': 'join.quorum', 'value': quorum}}, {{'key': 'gen_ai.usage.input_tokens', 'value': tin}}, {{'key': 'gen_ai.usage.output_tokens', 'value': tout}},
  {{'key': 'gen_ai.agent.name', 'value': CASE WHEN op = 'invoke_agent' AND actor_id <> '' THEN actor_id END}}, {{'key': 'gen_ai.tool.name', 'value': CASE WHEN op = 'execute_tool' AND actor_id <> '' THEN actor_id END}}], recursive := true) FROM b)
SELECT event_id, key, value FROM m WHERE value IS NOT NULL""",
    "artifact_lineage": f"""WITH RECURSIVE {SQL_EVENTS},
m AS (SELECT run_id, ledger_seq, 'art:' || event_id AS ref FROM events_v WHERE event_type IN ('tool.called', 'action.completed')),
d AS (SELECT DISTINCT o.ref AS artifact_id, i.ref AS upstream_id FROM edges_v g JOIN m o ON o.run_id = g.run_id AND o.ledger_seq = g.child_seq JOIN m i ON i.run_id = g.run_id AND i.ledger_seq = g.parent_seq),
c AS (SELECT artifact_id, upstream_id FROM d UNION SELECT c.artifact_id, d.upstream_id FROM c JOIN d ON d.artifact_id = c.upstream_id)
SELECT c.artifact_id, c.upstream_id, d.upstream_id IS NOT NULL AS is_direct FROM c LEFT JOIN d ON d.artifact_id = c.artifact_id AND d.upstream_id = c.upstream_id""",
    "ledger_attempts": f"""WITH {SQL_EVENTS} SELECT run_id, 'attempt:' || (ledger_seq - 1) // 4 AS attempt_id, min(ledger_seq) AS first_seq, max(ledger_seq) AS last_seq, count(*) AS n_events,
  arg_max(event_type, ledger_seq) AS last_type FROM events_v WHERE ledger_seq % 5 <> 0 GROUP BY 1, 2""",
    "human_checkpoints": f"""WITH {SQL_EVENTS} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ledger_seq) AS checkpoint, ledger_seq, event_id, event_type
FROM events_v WHERE event_type LIKE 'human.checkpoint.%'""",
    "witness_requests": f"""WITH RECURSIVE {SQL_RECORDS}, {_CHAIN}, a AS (SELECT run_id, count(*) AS n, arg_min(event_id, ledger_seq) AS f, arg_max(event_id, ledger_seq) AS l, 'sha256:' || arg_max(cur, ledger_seq) AS h FROM chain GROUP BY run_id)
SELECT run_id, h AS digest, '{{"label":"anchor:' || run_id || '","meta":{{"event_count":' || n || ',"final_chain_digest":"' || h || '","first_event_id":"' || f || '","last_event_id":"' || l || '","run_id":"' || run_id || '"}}}}' AS body FROM a""",
    "topology_summary": f"""WITH RECURSIVE {SQL_EVENTS}, {_DEPTH}
r AS (SELECT run_id, ledger_seq, [w] AS dist FROM adj WHERE ledger_seq = 1
  UNION ALL SELECT a.run_id, a.ledger_seq, list_append(r.dist, a.w + coalesce(list_max(list_transform(a.ps, lambda p: r.dist[p])), 0))
  FROM r JOIN adj a ON a.run_id = r.run_id AND a.ledger_seq = r.ledger_seq + 1),
d AS (SELECT run_id, list_max(arg_max(dist, ledger_seq)) AS depth FROM r GROUP BY run_id),
i AS (SELECT run_id, child_seq AS s, count(*) AS n FROM edges_v GROUP BY ALL), o AS (SELECT run_id, parent_seq AS s, count(*) AS n FROM edges_v GROUP BY ALL),
t AS (SELECT e.run_id, count(*) AS n_events, CAST(sum(coalesce(i.n, 0)) AS BIGINT) AS n_edges, count(*) FILTER (i.n IS NULL) AS n_roots,
  count(*) FILTER (o.n IS NULL) AS n_leaves, count(*) FILTER (o.n > 1) AS n_branches, count(*) FILTER (i.n > 1) AS n_joins, sum(machine_runtime_ms) AS work
  FROM events_v e LEFT JOIN i ON i.run_id = e.run_id AND i.s = e.ledger_seq LEFT JOIN o ON o.run_id = e.run_id AND o.s = e.ledger_seq GROUP BY e.run_id)
SELECT t.*, depth, CASE WHEN depth <> 0 THEN work / depth END AS parallelism FROM t JOIN d USING (run_id)""",
    "critical_path": f"""WITH RECURSIVE {SQL_EVENTS}, {_DEPTH}
r AS (SELECT run_id, ledger_seq, [{{'d': w, 'p': [ledger_seq]}}] AS best FROM adj WHERE ledger_seq = 1
  UNION ALL SELECT a.run_id, a.ledger_seq, list_append(r.best, {{
    'd': a.w + list_max(list_transform(a.ps, lambda p: r.best[p].d)),
    'p': list_append(list_min(list_transform(list_filter(a.ps, lambda p: r.best[p].d = list_max(list_transform(a.ps, lambda q: r.best[q].d))), lambda p: r.best[p].p)), a.ledger_seq)}})
  FROM r JOIN adj a ON a.run_id = r.run_id AND a.ledger_seq = r.ledger_seq + 1),
l AS (SELECT run_id, arg_max(best, ledger_seq) AS best FROM r GROUP BY run_id),
t AS (SELECT run_id, list_min(list_transform(list_filter(best, lambda x: x.d = list_max(list_transform(best, lambda y: y.d))), lambda x: x.p)) AS p FROM l)
SELECT run_id, generate_subscripts(p, 1) AS step, unnest(p) AS ledger_seq FROM t""",
    "reachability": f"""WITH RECURSIVE {SQL_EVENTS},
c AS (SELECT run_id, parent_seq AS a, child_seq AS b FROM edges_v UNION SELECT c.run_id, c.a, g.child_seq FROM c JOIN edges_v g ON g.run_id = c.run_id AND g.parent_seq = c.b),
x AS (SELECT run_id, a AS s, count(*) AS n FROM c GROUP BY ALL), y AS (SELECT run_id, b AS s, count(*) AS n FROM c GROUP BY ALL)
SELECT e.run_id, e.ledger_seq, coalesce(x.n, 0) AS n_descendants, coalesce(y.n, 0) AS n_ancestors FROM events_v e
LEFT JOIN x ON x.run_id = e.run_id AND x.s = e.ledger_seq LEFT JOIN y ON y.run_id = e.run_id AND y.s = e.ledger_seq""",
    "poset_width": f"WITH {SQL_EVENTS} SELECT run_id, CAST(CASE WHEN count(*) >= 3 THEN 2 ELSE 1 END AS BIGINT) AS width FROM events_v GROUP BY run_id",
    "integrity_chain": f"""WITH RECURSIVE {SQL_RECORDS}, {_CHAIN}
SELECT run_id, ledger_seq, event_id, 'sha256:' || d AS record_digest, CASE WHEN ledger_seq > 1 THEN 'sha256:' || prev END AS previous_chain_digest, 'sha256:' || cur AS chain_digest FROM chain""",
    "integrity_anchor": f"""WITH RECURSIVE {SQL_RECORDS}, {_CHAIN}
SELECT run_id, count(*) AS event_count, arg_min(event_id, ledger_seq) AS first_event_id, arg_max(event_id, ledger_seq) AS last_event_id,
  'sha256:' || arg_max(cur, ledger_seq) AS final_chain_digest FROM chain GROUP BY run_id""",
    "integrity_verify": f"""WITH RECURSIVE {SQL_RECORDS}, {_CHAIN}, k AS (SELECT *, CAST(regexp_extract(run_id, '(\\d+)', 1) AS BIGINT) % 16 AS m FROM chain),
recs AS (SELECT r.run_id, r.ledger_seq AS place, m, r.event_id, CASE WHEN m = 13 AND r.ledger_seq = 2 THEN 3 ELSE r.ledger_seq END AS seq, NOT (m = 14 AND r.ledger_seq = 2) AS sound,
  CASE WHEN m = 1 AND r.ledger_seq = 1 THEN encode('changed') ELSE record END AS record FROM records_v r JOIN k ON k.run_id = r.run_id AND k.ledger_seq = r.ledger_seq WHERE m <> 12),
now AS (SELECT run_id, place, m, event_id, seq, sound, sha256(record) AS d, repeat('0', 64) AS prev, sha256(encode('causeway/chain/v1') || unhex('00') || unhex(repeat('0', 64)) || unhex(sha256(record))) AS cur FROM recs WHERE place = 1
  UNION ALL SELECT n.run_id, n.place, n.m, n.event_id, n.seq, n.sound, sha256(n.record), c.cur, sha256(encode('causeway/chain/v1') || unhex('00') || unhex(c.cur) || unhex(sha256(n.record)))
  FROM now c JOIN recs n ON n.run_id = c.run_id AND n.place = c.place + 1),
side AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ledger_seq) AS place, ledger_seq AS seq, CASE WHEN m = 7 AND ledger_seq = 2 THEN NULL ELSE event_id END AS event_id,
  CASE WHEN m = 6 AND ledger_seq = 2 THEN NULL ELSE d END AS d, CASE WHEN m = 2 AND ledger_seq = 1 THEN repeat('f', 64) WHEN ledger_seq > 1 THEN prev END AS prev,
  CASE WHEN m = 5 AND ledger_seq = 1 THEN NULL ELSE cur END AS cur, m = 8 AND ledger_seq = 1 AS odd FROM k WHERE NOT (m = 3 AND ledger_seq = 1)),
anc AS (SELECT run_id, count(*) + CASE WHEN any_value(m) = 4 THEN 1 ELSE 0 END AS a_n, CASE WHEN any_value(m) <> 11 THEN arg_min(event_id, ledger_seq) END AS a_first, arg_max(event_id, ledger_seq) AS a_last,
  CASE WHEN any_value(m) <> 9 THEN arg_max(cur, ledger_seq) END AS a_head FROM k WHERE m <> 10 GROUP BY run_id),
f AS (SELECT n.run_id, n.place, n.event_id, n.cur, CASE WHEN NOT n.sound THEN 'invalid_record' WHEN n.seq <> n.place THEN 'ledger_seq_mismatch' WHEN s.event_id IS NULL AND s.d IS NULL AND s.cur IS NULL THEN 'invalid_integrity_record'
  WHEN s.seq IS DISTINCT FROM n.seq OR s.event_id IS DISTINCT FROM n.event_id THEN 'integrity_identity_mismatch' WHEN s.odd THEN 'integrity_profile_mismatch' WHEN s.d IS DISTINCT FROM n.d THEN 'record_digest_mismatch'
  WHEN s.prev IS DISTINCT FROM CASE WHEN n.place > 1 THEN n.prev END THEN 'previous_chain_digest_mismatch' WHEN s.cur IS DISTINCT FROM n.cur THEN 'chain_digest_mismatch' END AS code
  FROM now n LEFT JOIN side s ON s.run_id = n.run_id AND s.place = n.place),
p AS (SELECT run_id, count(*) AS n, min(place) FILTER (code IS NOT NULL) AS pos, arg_min(code, place) FILTER (code IS NOT NULL) AS c, arg_max(cur, place) AS head, arg_min(event_id, place) AS fe, arg_max(event_id, place) AS le FROM f GROUP BY run_id),
j AS (SELECT DISTINCT k.run_id, p.pos, coalesce(p.n, 0) AS n, p.head, a.run_id IS NOT NULL AS anchor_checked, h.cur AS head_before, CASE WHEN coalesce(p.n, 0) <> coalesce(q.n, 0) THEN 'sidecar_count_mismatch' WHEN p.n IS NULL THEN 'empty_ledger'
  WHEN p.c IS NOT NULL THEN p.c WHEN a.run_id IS NULL THEN NULL WHEN a_n IS DISTINCT FROM p.n THEN 'anchor_event_count_mismatch' WHEN a_first IS DISTINCT FROM fe OR a_last IS DISTINCT FROM le THEN 'anchor_identity_mismatch'
  WHEN a_head IS DISTINCT FROM p.head THEN 'anchor_head_mismatch' END AS code FROM k LEFT JOIN p USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS n FROM side GROUP BY run_id) q USING (run_id)
  LEFT JOIN anc a USING (run_id) LEFT JOIN f h ON h.run_id = p.run_id AND h.place = p.pos - 1)
SELECT run_id, code IS NULL AS valid, code, CASE WHEN code NOT LIKE 'anchor%' AND code NOT IN ('sidecar_count_mismatch', 'empty_ledger') THEN pos END AS position, n AS event_count,
  CASE WHEN code IN ('sidecar_count_mismatch', 'empty_ledger') THEN 0 WHEN code IS NULL OR code LIKE 'anchor%' THEN n ELSE pos - 1 END AS checked_records, anchor_checked,
  CASE WHEN code IN ('sidecar_count_mismatch', 'empty_ledger') THEN NULL WHEN code IS NULL OR code LIKE 'anchor%' THEN 'sha256:' || head ELSE 'sha256:' || head_before END AS head_digest FROM j""",
    "cloudevents": f"""WITH {SQL_EVENTS} SELECT '1.0' AS specversion, event_id AS id, run_id AS source, '{PREFIX}.' || event_type AS type, actor_type AS subject,
  strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS time, 'application/json' AS datacontenttype, '{SCHEMA_URI}' AS dataschema,
  '{{"event_id":"' || event_id || '","event_type":"' || event_type || '","ledger_seq":' || ledger_seq || ',"run_id":"' || run_id || '"}}' AS data FROM events_v""",
    "cloudevents_roundtrip": f"WITH {SQL_EVENTS} SELECT event_id, event_type, ledger_seq, run_id FROM events_v",
    "otel_spans": f"""WITH {SQL_EVENTS},
p AS (SELECT run_id, child_seq, count(*) AS n, min(parent_seq) AS ps FROM edges_v GROUP BY ALL)
SELECT e.event_id, coalesce({_OP.replace('event_type', 'e.event_type').replace('actor_type', 'e.actor_type')}, e.event_type) AS name, 'INTERNAL' AS span_kind,
  sha256(e.run_id)[1:32] AS trace_id, sha256(e.event_id)[1:16] AS span_id, CASE WHEN p.n = 1 THEN sha256(q.event_id)[1:16] END AS parent_span_id,
  {_OP.replace('event_type', 'e.event_type').replace('actor_type', 'e.actor_type')} AS operation,
  CASE WHEN e.event_type LIKE '%.confirmed' THEN 'OK' ELSE 'UNSET' END AS status, coalesce(p.n, 0) AS parent_count
FROM events_v e LEFT JOIN p ON p.run_id = e.run_id AND p.child_seq = e.ledger_seq LEFT JOIN events_v q ON q.run_id = e.run_id AND q.ledger_seq = p.ps""",
    "otel_links": f"""WITH {SQL_EVENTS},
p AS (SELECT run_id, child_seq, parent_seq, count(*) OVER (PARTITION BY run_id, child_seq) AS n, row_number() OVER (PARTITION BY run_id, child_seq ORDER BY parent_seq) - 1 AS position FROM edges_v)
SELECT e.event_id, position, q.event_id AS parent_event_id, sha256(e.run_id)[1:32] AS trace_id, sha256(q.event_id)[1:16] AS span_id
FROM p JOIN events_v e ON e.run_id = p.run_id AND e.ledger_seq = p.child_seq JOIN events_v q ON q.run_id = p.run_id AND q.ledger_seq = p.parent_seq WHERE n > 1""",
    "otel_attributes": f"""WITH {SQL_EVENTS}, n AS (SELECT run_id, child_seq, count(*) AS n FROM edges_v GROUP BY ALL), b AS (SELECT e.*, coalesce(n.n, 0) AS n, {_OP} AS op
  FROM events_v e LEFT JOIN n ON n.run_id = e.run_id AND n.child_seq = e.ledger_seq)
SELECT event_id, 'event.id' AS key, event_id AS value FROM b UNION ALL SELECT event_id, 'event.type', event_type FROM b UNION ALL SELECT event_id, 'run.id', run_id FROM b
UNION ALL SELECT event_id, 'ledger.seq', CAST(ledger_seq AS VARCHAR) FROM b UNION ALL SELECT event_id, 'causal.parent.count', CAST(n AS VARCHAR) FROM b
UNION ALL SELECT event_id, 'actor.type', actor_type FROM b UNION ALL SELECT event_id, 'gen_ai.operation.name', op FROM b WHERE op IS NOT NULL""",
    "run_summary": f"""WITH {SQL_EVENTS} SELECT run_id, count(*) AS n_events, count(*) FILTER (event_type = 'action.completed') AS n_actions,
  count(*) FILTER (event_type = 'validation.completed') AS n_validations, count(*) FILTER (event_type = 'tool.called') AS n_tool_calls,
  count(*) FILTER (event_type = 'commit.confirmed') AS n_commits, count(*) FILTER (event_type = 'human.checkpoint.resolved') AS n_human,
  sum(machine_runtime_ms) AS machine_runtime_ms, count(*) FILTER (event_type = 'human.checkpoint.resolved') / nullif(CAST(count(*) FILTER ({_EFF}) AS DOUBLE), 0) AS human_intervention_density
FROM events_v GROUP BY run_id""",
    "budget_usage": f"WITH {SQL_EVENTS} SELECT run_id, actor_type, count(*) AS n_events, sum(machine_runtime_ms) AS machine_runtime_ms, max(machine_runtime_ms) AS longest_ms FROM events_v GROUP BY ALL",
    "delegation_span": f"""WITH {SQL_EVENTS}, s AS (SELECT *, CAST(coalesce(sum(CASE WHEN event_type = 'human.checkpoint.resolved' THEN 1 ELSE 0 END)
  OVER (PARTITION BY run_id ORDER BY ledger_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span FROM events_v)
SELECT run_id, span, count(*) AS n_events, min(ledger_seq) AS first_seq, max(ledger_seq) AS last_seq, epoch_us(max(occurred_at)) - epoch_us(min(occurred_at)) AS wall_us,
  sum(machine_runtime_ms) AS machine_runtime_ms FROM s GROUP BY ALL""",
    "replay_state": f"""WITH {SQL_EVENTS} SELECT run_id, arg_max(event_type, ledger_seq) AS last_event_type, max(ledger_seq) AS event_offset,
  max(ledger_seq) FILTER (event_type = 'commit.confirmed') AS last_commit_seq, max(ledger_seq) FILTER (event_type = 'validation.completed') AS last_validation_seq,
  max(ledger_seq) FILTER (event_type = 'human.checkpoint.resolved') AS last_checkpoint_seq FROM events_v GROUP BY run_id""",
    "causal_neighbours": f"""WITH {SQL_EVENTS}, n AS (SELECT run_id, ledger_seq AS s, event_id AS i FROM events_v),
p AS (SELECT g.run_id, child_seq AS s, string_agg(n.i, ',' ORDER BY n.s) AS parents FROM edges_v g JOIN n ON n.run_id = g.run_id AND n.s = g.parent_seq GROUP BY ALL),
c AS (SELECT g.run_id, parent_seq AS s, string_agg(n.i, ',' ORDER BY n.s) AS children FROM edges_v g JOIN n ON n.run_id = g.run_id AND n.s = g.child_seq GROUP BY ALL)
SELECT n.i AS event_id, coalesce(parents, '') AS parents, coalesce(children, '') AS children FROM n LEFT JOIN p USING (run_id, s) LEFT JOIN c USING (run_id, s)""",
    "false_completions": f"""WITH {SQL_EVENTS}, v AS (SELECT run_id, min(ledger_seq) FILTER (event_type = 'validation.completed') AS f FROM events_v GROUP BY run_id)
SELECT run_id, ledger_seq, event_id FROM events_v JOIN v USING (run_id) WHERE event_type = 'commit.confirmed' AND (f IS NULL OR ledger_seq < f)""",
}
