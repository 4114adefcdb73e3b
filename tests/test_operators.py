"""Known values and edge cases of the ledger, governance, calibration and geometry operators."""

from __future__ import annotations

import datetime
import hashlib
import itertools
import random

import numpy as np
import pytest
from causeway.functions.expr import keyed_uniform
from causeway.operators import calibration as cal
from causeway.operators import geometry as geo
from causeway.operators import governance as gov
from causeway.operators import authority, contracts, integrity, interop, topology, witness
from causeway.operators import ledger as ledger_ops
from pyspark.sql import functions as F


def ledger(spark, parents: dict[int, list[int]], weights=None, run="r"):
    rows = [(run, s, f"evt_{s}", ps, float((weights or {}).get(s, 1.0))) for s, ps in parents.items()]
    return spark.createDataFrame(rows, "run_id string, ledger_seq long, event_id string, parent_seqs array<long>, machine_runtime_ms double")


SEVEN = {1: [], 2: [1], 3: [2], 4: [2], 5: [2], 6: [3, 4, 5], 7: [6]}


def test_seven_node_graph(spark):
    row = topology.summary(ledger(spark, SEVEN)).first()
    assert (row.n_events, row.n_edges, row.work, row.depth) == (7, 8, 7.0, 5.0)
    assert (row.n_roots, row.n_leaves, row.n_branches, row.n_joins) == (1, 1, 1, 1)
    assert row.parallelism == 7 / 5
    path = [r.ledger_seq for r in topology.critical_path(ledger(spark, SEVEN)).orderBy("step").collect()]
    assert path == [1, 2, 3, 6, 7]
    assert topology.width(ledger(spark, SEVEN)).first().width == 3


def test_weights_choose_the_slowest_branch(spark):
    path = topology.critical_path(ledger(spark, SEVEN, {4: 9.0})).orderBy("step").collect()
    assert [r.ledger_seq for r in path] == [1, 2, 4, 6, 7]


def test_out_of_order_ledger_and_cycle(spark):
    assert topology.summary(ledger(spark, {1: [3], 2: [], 3: [2]})).first().depth == 3
    with pytest.raises(Exception, match="cycle"):
        topology.summary(ledger(spark, {1: [2], 2: [1]})).collect()


def test_violations(spark):
    bad = ledger(spark, {1: [1], 2: [9], 3: [4], 4: []})
    rules = {(r.ledger_seq, r.rule) for r in topology.violations(bad).collect()}
    assert rules == {(1, "self_parent"), (2, "unknown_parent"), (2, "parent_not_before"), (3, "parent_not_before")}


def test_longest_path_and_width_by_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 8)
        parents = {i: sorted(rng.sample(range(1, i), min(i - 1, rng.randint(0, 2)))) for i in range(1, n + 1)}
        weight = {i: float(rng.randint(0, 3)) for i in parents}
        order = topology._topological(parents)

        def paths(v, parents=parents):
            return [[v]] if not parents[v] else [p + [v] for u in parents[v] for p in paths(u)]

        every = [p for v in parents for p in paths(v)]
        depth = max(sum(weight[x] for x in p) for p in every)
        found = topology._longest(order, parents, weight)
        assert found == min(p for p in every if sum(weight[x] for x in p) == depth)
        below = topology._closure(order, parents)
        at = {v: i for i, v in enumerate(order)}
        antichains = (s for k in range(n, 0, -1) for s in itertools.combinations(order, k))
        widest = next(len(s) for s in antichains if not any(below[a] >> at[b] & 1 for a in s for b in s))
        assert n - topology._matching([below[v] for v in order]) == widest


def records(spark, texts):
    rows = [("r", i + 1, f"e{i + 1}", t.encode()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "run_id string, ledger_seq long, event_id string, record binary")


def verdict(records_, side, anchor):
    row = integrity.verify(records_, side, anchor).first()
    return row.valid, row.code


def test_integrity_tamper_matrix(spark):
    good = records(spark, ["a", "b", "c"])
    side = integrity.seal(good)
    anchor = integrity.anchors(side)
    assert verdict(good, side, anchor) == (True, None)
    assert verdict(records(spark, ["a", "x", "c"]), side, anchor) == (False, "record_digest_mismatch")
    assert verdict(records(spark, ["a", "b"]), side, anchor) == (False, "sidecar_count_mismatch")
    short = records(spark, ["a", "b"])
    assert verdict(short, integrity.seal(short), anchor) == (False, "anchor_event_count_mismatch")
    relinked = side.withColumn("chain_digest", F.lit("sha256:" + "0" * 64))
    assert verdict(good, relinked, anchor) == (False, "chain_digest_mismatch")
    assert verdict(good, side, anchor.withColumn("final_chain_digest", F.lit("sha256:" + "0" * 64))) == (False, "anchor_head_mismatch")
    none = F.lit(None).cast("string")
    at2 = F.col("ledger_seq") == 2

    def nulled(df, name):
        return df.withColumn(name, F.when(~at2, F.col(name)).otherwise(none))

    for name, code in (("record_digest", "record_digest_mismatch"), ("previous_chain_digest", "previous_chain_digest_mismatch"), ("chain_digest", "chain_digest_mismatch"), ("event_id", "integrity_identity_mismatch")):
        assert verdict(good, nulled(side, name), anchor) == (False, code)
    blank = nulled(nulled(nulled(side, "event_id"), "record_digest"), "chain_digest")
    assert verdict(good, blank, anchor) == (False, "invalid_integrity_record")
    for name, code in (("final_chain_digest", "anchor_head_mismatch"), ("last_event_id", "anchor_identity_mismatch")):
        assert verdict(good, side, anchor.withColumn(name, none)) == (False, code)
    assert verdict(good, side, anchor.withColumn("event_count", F.lit(None).cast("long"))) == (False, "anchor_event_count_mismatch")
    assert verdict(good, side.withColumn("hash_algorithm", F.lit("md5")), anchor) == (False, "integrity_profile_mismatch")
    assert verdict(good, side, anchor.withColumn("record_encoding", F.lit("text"))) == (False, "anchor_profile_mismatch")
    assert verdict(good, side, anchor.limit(0)) == (True, None)
    assert integrity.verify(good, side, anchor.limit(0), require_anchor=True).first().code == "anchor_missing"
    assert verdict(good.limit(0), side, anchor) == (False, "sidecar_count_mismatch")
    assert verdict(good.limit(0), side.limit(0), anchor) == (False, "empty_ledger")


def test_ledgers_of_json_records(spark):
    rows = [("L", 1, b'{"run_id":"r","ledger_seq":1,"event_id":"a"}'), ("L", 2, b'{"run_id":"q","ledger_seq":2,"event_id":"b"}'), ("M", 1, b"not json"), ("N", 1, b'{"run_id":"r","ledger_seq":3,"event_id":"c"}')]
    parsed = integrity.parse(spark.createDataFrame(rows, "ledger string, position long, record binary"))
    side = integrity.seal(parsed.select(F.col("ledger").alias("run_id"), F.col("position").alias("ledger_seq"), "event_id", "record"))
    side = side.select(F.col("run_id").alias("ledger"), F.lit("r").alias("run_id"), "ledger_seq", "event_id", "record_digest", "previous_chain_digest", "chain_digest")
    anchor = spark.createDataFrame([], "ledger string, run_id string, event_count long, first_event_id string, last_event_id string, final_chain_digest string")
    got = {r.ledger: (r.code, r.position, r.checked_records) for r in integrity.verify(parsed, side, anchor, ledger="ledger").collect()}
    assert got == {"L": ("run_id_mismatch", 2, 1), "M": ("invalid_record", 1, 0), "N": ("ledger_seq_mismatch", 1, 0)}


def test_chain_in_blocks_is_the_same(spark):
    good = records(spark, [f"text {i}" for i in range(23)])
    whole, parts = integrity.seal(good), integrity.seal(good, block=5)
    assert sorted(whole.collect()) == sorted(parts.collect())


def test_witness_matches_digests(spark):
    anchor = spark.createDataFrame([("r1", "d1"), ("r2", "d2")], "run_id string, final_chain_digest string")
    seen = spark.createDataFrame([("r1", "i1", "d1", "sig"), ("r2", "i2", "zz", "sig")], "run_id string, instant_id string, digest string, signature string")
    got = {r.run_id: r.code for r in witness.match(anchor, seen).collect()}
    assert got == {"r1": None, "r2": "digest_mismatch"}
    unsigned = seen.withColumn("signature", F.lit(None).cast("string"))
    assert {r.code for r in witness.match(anchor, unsigned).collect()} == {"unsigned", "digest_mismatch"}


def test_status_words(spark):
    df = spark.createDataFrame([("Failed",), ("OK",), ("running",), (None,)], "s string").select(interop.status(F.col("s")).alias("x"))
    assert [r.x for r in df.collect()] == ["ERROR", "OK", "UNSET", "UNSET"]


def test_boundaries_of_deadlines(spark):
    at = F.lit("2024-01-11 00:00:00").cast("timestamp")
    req = spark.sql("select 'a' approval_id, 'high' risk_class, timestamp'2024-01-01' requested_at, timestamp'2024-01-11' expires_at, cast(null as timestamp) explicit_deadline")
    none = spark.createDataFrame([], "approval_id string, decision string, decided_at timestamp, human_governance_ms long")
    row = gov.timing(req, none, at).first()
    assert row.is_open and not row.is_overdue and row.open_age_ms == 864_000_000
    assert gov.expire_due(req, none, at).first().status == "expired"
    exact = spark.sql("select 'a' approval_id, 'approve' decision, timestamp'2024-01-11' decided_at, 5L human_governance_ms")
    row = gov.timing(req, exact, at).first()
    assert row.is_effective and row.margin_ms == 0 and row.latency_ratio == 1.0
    assert gov.expire_due(req, exact, at).first().status == "approved"


def evidence(spark, table, **extra):
    rows = [(*k, d, t, s) for k, pts in table.items() for d, t, s in pts]
    return spark.createDataFrame(rows, "snapshot_id string, family_id string, subject string, depth long, trials long, successes long")


def test_reference_suite_horizons(spark):
    t = {
        ("s", "f", "autonomy"): [(4, 20, 20), (8, 20, 19), (12, 20, 18), (16, 20, 10)],
        ("s", "f", "governance"): [(3, 20, 20), (6, 20, 19), (9, 20, 18), (12, 20, 10)],
    }
    keys = ("snapshot_id", "family_id", "subject")
    h = cal.horizons(cal.curves(cal.points(evidence(spark, t), *keys), *keys).withColumn("target", F.lit(0.9)))
    row = cal.assessment(h, "snapshot_id", "family_id").first()
    assert (row.h_autonomy, row.h_governance, row.gap) == (12.0, 9.0, 3.0)


SNAPSHOTS = {
    ("base", "code", "autonomy"): [(4, 40, 40), (8, 40, 38), (12, 40, 36), (16, 40, 20)],
    ("base", "code", "governance"): [(3, 40, 40), (6, 40, 38), (9, 40, 36), (12, 40, 20)],
    ("base", "research", "autonomy"): [(2, 10, 10), (4, 10, 10), (6, 10, 9), (8, 10, 5)],
    ("base", "research", "governance"): [(1, 10, 10), (3, 10, 10), (5, 10, 9), (7, 10, 5)],
    ("current", "code", "autonomy"): [(4, 10, 10), (8, 10, 10), (12, 10, 10), (16, 10, 7)],
    ("current", "code", "governance"): [(3, 10, 10), (6, 10, 10), (9, 10, 10), (12, 10, 7)],
    ("current", "research", "autonomy"): [(2, 40, 40), (4, 40, 40), (6, 40, 38), (8, 40, 28)],
    ("current", "research", "governance"): [(1, 40, 40), (3, 40, 40), (5, 40, 38), (7, 40, 28)],
}


def test_reference_snapshot_comparison(spark):
    keys = ("snapshot_id", "family_id", "subject")
    pts = cal.points(evidence(spark, SNAPSHOTS), *keys)
    curves = cal.curves(pts, *keys)
    targets = spark.createDataFrame([(0, 0.9)], "obs int, target double")
    half = spark.sql("select 'half' cell, map('code', 0.5D, 'research', 0.5D) weights")
    adjusted = {r.subject: r.delta for r in cal.deltas(cal.mixtures(curves, half, targets, "snapshot_id"), "subject").collect()}
    assert adjusted["autonomy"] == pytest.approx(0.8470588235294114)
    assert adjusted["governance"] == pytest.approx(0.8923076923076918)
    w = cal.observed_weights(pts, "snapshot_id")
    own = w.groupBy("snapshot_id", "subject").agg(F.map_from_entries(F.collect_list(F.struct("family_id", "weight"))).alias("weights"))
    mixed = cal.mixtures(curves.join(own, ["snapshot_id", "subject"]), None, targets, "snapshot_id")
    observed = {r.subject: r.delta for r in cal.deltas(mixed, "subject").collect()}
    assert observed["autonomy"] == pytest.approx(-0.6)
    assert observed["governance"] == pytest.approx(-0.4)


def test_resampling_does_not_depend_on_partitions(spark):
    pts = cal.points(evidence(spark, SNAPSHOTS), "snapshot_id", "family_id", "subject")
    a = cal.resample(pts.repartition(3), "s", 4)
    b = cal.resample(pts.coalesce(1), "s", 4)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert cal.resample(pts, "t", 4).exceptAll(a).count() > 0


def test_draws_are_judged_as_digests_and_points_are_read_once(spark, tmp_path):
    """Counts are those of keyed uniforms below the rate, for rates from one in ten thousand to all but one; the source is not read again for them."""
    rows = [("base", "A", None, k, n, x) for k, (n, x) in enumerate([(10_000, 1), (10_000, 9_999), (3, 1), (64, 32), (7, 0), (7, 7)], 1)]
    pts = spark.createDataFrame(rows, "snapshot_id string, family_id string, subject string, depth long, trials long, successes long")
    pts.write.parquet(f"{tmp_path}/points")
    got = cal.resample(spark.read.parquet(f"{tmp_path}/points"), "s", 3)
    u = keyed_uniform(F.lit("s"), *[F.col(c).cast("string") for c in ("snapshot_id", "rep", "family_id", "subject", "depth", "attempt")])
    each = pts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trials") - 1)))
    want = each.groupBy("rep", "depth").agg(F.count_if(u < F.col("successes").cast("double") / F.col("trials").cast("double")).alias("n"))
    assert {(r.rep, r.depth, r.successes) for r in got.collect()} == {(r.rep, r.depth, r.n) for r in want.collect()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and "parquet" not in plan


def test_grid_and_edges(spark):
    grid = cal.simplex_grid(spark, ("x", "y", "z"), units=10, least=1)
    assert grid.count() == 36
    assert cal.simplex_grid(spark, ("x",), units=3).collect()[0].units == [3]
    flat = grid.select(F.lit(0).alias("obs"), F.lit("s").alias("subject"), "cell", "units", F.lit(True).alias("supported"), F.lit("positive_band").alias("sign_class"), F.lit(1.0).alias("lower"), F.lit(2.0).alias("upper"), F.lit(1.5).alias("delta"))
    assert geo.edges(flat).count() == 84
    assert geo.components(flat).select("component").distinct().count() == 1
    assert geo.crossings(flat).count() == 0
    assert geo.summary(flat).first().n_supported == 36


def test_greedy_matching_takes_the_closest_first(spark):
    rows = [(0, "s", "lower", "a", "b", [1.0, 0.0]), (0, "s", "lower", "c", "d", [2.0, 0.0]), (1, "s", "lower", "e", "f", [1.9, 0.0])]
    crossed = spark.createDataFrame(rows, "obs int, subject string, field string, cell_a string, cell_b string, at array<double>")
    got = geo.greedy_matches(crossed).collect()
    assert [(r.a_key, r.b_key, r.distance) for r in got] == [("c>d", "e>f", 0.1)]
    chains = {r.lineage: r.n_nodes for r in geo.boundary_lineages(geo.greedy_matches(crossed), crossed).collect()}
    assert chains == {"0000@a>b": 1, "0000@c>d": 2}


def test_missing_families_and_agreement(spark):
    schema = "snapshot_id string, family_id string, subject string, status string, horizon double"
    rows = [("base", "a", "x", "supported", 2.0), ("current", "a", "x", "supported", 5.0), ("base", "b", "x", "supported", 4.0), ("current", "b", "x", "supported", 3.0)]
    rows += [("base", "c", "x", "supported", 9.0), ("current", "d", "x", "target_not_bracketed_low", None)]
    families = cal.family_deltas(spark.createDataFrame(rows, schema))
    got = {r.family_id: (r.base_status, r.current_status, r.reasons, r.delta, r.direction) for r in families.collect()}
    assert got["a"] == ("supported", "supported", "", 3.0, 1) and got["b"][3:] == (-1.0, -1)
    assert got["c"] == ("supported", "missing_family", "current:missing_family", None, None)
    assert got["d"] == ("missing_family", "target_not_bracketed_low", "base:missing_family;current:target_not_bracketed_low", None, None)

    def agreed(adjusted, days):
        change = spark.createDataFrame([("x", adjusted)], "subject string, adjusted_delta double")
        return cal.agreement(families, change, spark.createDataFrame([(days,)], "elapsed_days double")).first()

    r = agreed(2.0, 4.0)
    assert (r.supported_fraction, r.direction_agreement, r.per_day, r.max_abs_delta) == (0.5, 0.5, 0.5, 3.0)
    assert (r.base_least, r.base_greatest, r.current_least, r.current_greatest) == (2.0, 9.0, 3.0, 5.0)
    assert agreed(2.0, 0.0).per_day is None and agreed(None, 4.0).direction_agreement is None
    assert agreed(0.0, 4.0).direction_agreement == 0.0


def test_context_of_a_comparison(spark):
    def of(current, when="2024-01-03 12:00:00", base=("b1", "v1", "c1", ["a", "b"])):
        rows = [("base", "2024-01-01 00:00:00", *base)] + ([("current", when, *current)] if current else [])
        df = spark.createDataFrame(rows, "snapshot_id string, observed_at string, backend_id string, benchmark_version string, agent_config_id string, families array<string>")
        r = cal.context(df.withColumn("observed_at", F.col("observed_at").cast("timestamp"))).first()
        return r.comparison_kind, r.elapsed_days, r.violation

    assert of(("b1", "v1", "c1", ["b", "a", "a"])) == ("longitudinal_same_configuration", 2.5, None)
    assert of(("b2", "v1", "c1", ["a", "b"]))[0] == "cross_backend"
    assert of(("b2", "v2", "c1", ["a", "b"]))[0] == "mixed_configuration_change"
    assert of(("b1", "v1", "c1", ["a"]))[0] == "mixed_configuration_change"
    assert of(("b1", "v1", None, ["a", "b"]), base=("b1", "v1", None, ["a", "b"]))[0] == "longitudinal_same_configuration"
    assert of(("b1", "v1", "c1", ["a", "b"]), "2023-12-31 00:00:00")[2] == "current_precedes_base"
    assert of(None)[1:] == (None, "missing_snapshot")


def test_gap_needs_its_contract(spark):
    rows = [("ok", "interaction_depth", 0.9, "s", "m", 5.0, 2.0), ("unit", "hours", 0.9, "s", "m", 5.0, 2.0), ("null", None, None, None, "", 5.0, 2.0)]
    rows += [("neg", "interaction_depth", 1.0, "s", "m", -1.0, 2.0), ("open", "interaction_depth", 0.9, "s", "m", None, 2.0), ("p", "interaction_depth", 1.1, "s", "m", 5.0, 2.0)]
    df = spark.createDataFrame(rows, "assessment_id string, unit string, reliability_p double, scope_id string, assessment_method string, h_autonomy double, h_governance double")
    got = {r.assessment_id: (r.autonomy_governance_gap, r.governance_margin, r.violations) for r in gov.horizon_gap(df).collect()}
    assert got == {
        "ok": (3.0, -3.0, []),
        "unit": (None, None, ["unit_not_interaction_depth"]),
        "null": (None, None, ["unit_not_interaction_depth", "reliability_out_of_range", "scope_missing", "method_missing"]),
        "neg": (None, None, ["negative_depth"]),
        "open": (None, None, []),
        "p": (None, None, ["reliability_out_of_range"]),
    }


def machine(log):
    """Outcomes of a log of approval commands, one after the other."""
    q, ids, refs, out = {}, set(), set(), []
    for c in sorted(log, key=lambda c: c["seq"]):
        a = q.get(c["approval_id"])
        if c["kind"] == "enqueue":
            code = "duplicate_approval_id" if a else "accepted"
            if not a:
                q[c["approval_id"]] = {"run": c["run_id"], "ends": c["expires_at"], "status": "pending"}
        elif a is None:
            code = "unknown_approval"
        elif a["status"] != "pending":
            code = "not_pending"
        elif c["kind"] == "expire":
            code = "accepted" if c["at"] >= a["ends"] else "not_due"
            a["status"] = "expired" if code == "accepted" else "pending"
        else:
            g = c["authority_ref"]
            checks = [
                (c["run_id"] != a["run"], "run_mismatch"), (c["at"] > a["ends"], "expired_before_decision"),
                (g is not None and c["decision"] not in ("approve", "modify"), "grant_not_allowed"),
                (g is not None and c["grant_decision_id"] != c["decision_id"], "grant_decision_mismatch"),
                (c["decision_id"] in ids, "duplicate_decision_id"), (g in refs, "duplicate_authority_ref"),
            ]
            code = next((x for bad, x in checks if bad), "accepted")
            if code == "accepted":
                ids.add(c["decision_id"])
                refs |= {g} - {None}
                a["status"] = gov.STATUS[c["decision"]]
        out.append((c["seq"], code, q[c["approval_id"]]["status"] if c["approval_id"] in q else None))
    return out


LOG = "seq long, approval_id string, kind string, run_id string, expires_at timestamp, decision_id string, decision string, at timestamp, authority_ref string, grant_decision_id string"


def command(seq, approval, kind, decision=None, grant=None, said="approve", run="r", day=1, given=None):
    at = datetime.datetime(2024, 1, day)
    if kind == "enqueue":
        return dict(seq=seq, approval_id=approval, kind=kind, run_id=run, expires_at=datetime.datetime(2024, 1, 10), decision_id=None, decision=None, at=None, authority_ref=None, grant_decision_id=None)
    if kind == "expire":
        return dict(seq=seq, approval_id=approval, kind=kind, run_id=None, expires_at=None, decision_id=None, decision=None, at=at, authority_ref=None, grant_decision_id=None)
    return dict(seq=seq, approval_id=approval, kind=kind, run_id=run, expires_at=None, decision_id=decision, decision=said, at=at, authority_ref=grant, grant_decision_id=given or (grant and decision))


def folded(spark, log):
    rows = spark.createDataFrame([tuple(c[x.split()[0]] for x in LOG.split(", ")) for c in log], LOG)
    return [(r.seq, r.outcome, r.status) for r in gov.fold_approvals(rows).orderBy("seq").collect()]


def test_ids_that_pass_from_one_approval_to_the_next(spark):
    begun = [command(i, x, "enqueue") for i, x in enumerate("ABC")]
    log = [*begun, command(10, "A", "resolve", "d1"), command(11, "B", "resolve", "d1"), command(12, "B", "resolve", "d2"), command(13, "C", "resolve", "d2")]
    assert [x[1] for x in folded(spark, log)[3:]] == ["accepted", "duplicate_decision_id", "accepted", "duplicate_decision_id"]
    log = [*begun, command(10, "A", "resolve", "d1", "g"), command(11, "B", "resolve", "d2", "g"), command(12, "C", "resolve", "d2")]
    assert [x[1] for x in folded(spark, log)[3:]] == ["accepted", "duplicate_authority_ref", "accepted"]
    # a chain in which each approval's first id is the one that the approval before got at last
    log, want = [command(i, f"a{i}", "enqueue") for i in range(12)], []
    for i in range(12):
        log += [command(100 + 2 * i, f"a{i}", "resolve", f"d{i}"), command(101 + 2 * i, f"a{i}", "resolve", f"d{i + 1}")]
    assert folded(spark, log) == machine(log)


def test_random_logs_equal_a_sequential_machine(spark):
    for seed in range(6):
        rng = random.Random(seed)
        log = []
        for seq in range(220):
            x, kind = f"a{rng.randrange(25)}", rng.choices(["enqueue", "resolve", "expire"], [3, 8, 1])[0]
            d, grant = f"d{rng.randrange(14)}", rng.choice([None, None, f"g{rng.randrange(9)}"])
            said = rng.choice(["approve", "modify", "deny", "defer", "cancel"] if grant is None or rng.random() < 0.1 else ["approve", "modify"])
            log.append(command(seq, x, kind, d, grant, said, rng.choice(["r"] * 9 + ["s"]), rng.choice([1, 2, 10, 11]), rng.choice([None] * 9 + ["d0"])))
        assert folded(spark, log) == machine(log), seed


def test_a_ledger_seq_of_any_size_costs_nothing(spark):
    rows = [("r", 1, "a", b"x"), ("r", 10**12, "b", b"y")]
    bad = spark.createDataFrame(rows, "run_id string, ledger_seq long, event_id string, record binary")
    side = integrity.seal(bad)
    assert side.count() == 2 and integrity.verify(bad, side, integrity.anchors(side)).first().code == "ledger_seq_mismatch"


def test_closure_in_blocks_is_the_same(spark):
    rng = random.Random(4)
    parents = {i: sorted(rng.sample(range(1, i), min(i - 1, rng.randrange(3)))) for i in range(1, 300)}
    events = ledger(spark, parents)
    whole = {tuple(r) for r in topology.reachability(events).collect()}
    assert whole == {tuple(r) for r in topology.reachability(events, task_bits=300 * 70).collect()}
    above = {}
    for n in parents:
        above[n] = set(parents[n]).union(*(above[p] for p in parents[n]))
    assert whole == {("r", n, sum(n in a for a in above.values()), len(above[n])) for n in parents}
    with pytest.raises(Exception, match="closure passes"):
        topology.width(events, task_bits=1000).collect()


def test_artifacts_upstream(spark):
    rows = [("r", None, ["a"]), ("r", ["a", None], ["b", "c"]), ("q", ["b"], ["d"]), ("q", ["d"], None), ("q", [], ["e"]), ("s", ["y"], ["x"]), ("s", ["x"], ["y"]), ("q", ["b"], ["d"])]
    got = {tuple(r) for r in ledger_ops.artifact_lineage(spark.createDataFrame(rows, "run_id string, input_refs array<string>, output_refs array<string>")).collect()}
    assert got == {("b", "a", True), ("c", "a", True), ("d", "b", True), ("d", "a", False), ("x", "y", True), ("y", "x", True), ("x", "x", False), ("y", "y", False)}
    chain = [("r", [f"a{i}"], [f"a{i + 1}"]) for i in range(40)]
    got = ledger_ops.artifact_lineage(spark.createDataFrame(chain, "run_id string, input_refs array<string>, output_refs array<string>"))
    assert got.count() == 40 * 41 // 2 and got.where("is_direct").count() == 40


def test_witness_nulls_and_schemes(spark):
    anchor = spark.createDataFrame([(r, d) for r, d in (("n", None), ("a", "d"), ("b", "d"), ("c", "d"), ("e", "d"))], "run_id string, final_chain_digest string")
    plain, bound = witness.SIGNED_FIELDS_PLAIN, witness.SIGNED_FIELDS_WITH_PAYLOAD
    rows = [("n", "i", None, "s", plain, None, None), ("a", "i", "d", "s", plain, None, None), ("b", "i", "d", "s", bound, 'x"y', '{"z":1,"a":{"d":2,"c":[]}}'), ("c", "i", "d", "s", "else", None, None), ("e", "", "d", "s", plain, None, None)]
    seen = spark.createDataFrame([(*r, "5", "tai") for r in rows], "run_id string, instant_id string, digest string, signature string, signed_fields string, label string, meta string, unix_ns string, reference_timescale string")
    assert {r.run_id: r.code for r in witness.match(anchor, seen).collect()} == {"n": "digest_mismatch", "a": None, "b": None, "c": "unsupported_signed_fields", "e": "missing_instant_id"}
    said = {r.run_id: (r.signed_string, r.meta_bound) for r in witness.signed_strings(seen).collect()}
    body = hashlib.sha256(b'{"label":"x\\"y","meta":{"a":{"c":[],"d":2},"z":1}}').hexdigest()
    assert said["a"] == ("i|5|tai", False) and said["b"] == (f"i|5|tai|{body}", True) and said["c"] == (None, False)
    assert [r.run_id for r in witness.requests(anchor.where("final_chain_digest is null")).collect()] == []


def test_closest_pairs_equal_all_pairs():
    rng = np.random.default_rng(1)
    for t in range(120):
        n, m, k = int(rng.integers(0, 25)), int(rng.integers(0, 25)), int(rng.integers(1, 4))
        a, b = (rng.integers(0, 6, (x, k)) / rng.choice([1, 2, 3]) for x in (n, m))
        if t % 5 == 0 and n:
            a = np.repeat(a[:1], n, 0)  # points of one place
        ka, kb = [f"a{i:03}" for i in range(n)], [f"b{rng.integers(99)}_{i}" for i in range(m)]
        used_a, used_b, want = set(), set(), []
        for d, _, _, i, j in sorted((round(float(np.abs(a[i] - b[j]).sum()), 9), ka[i], kb[j], i, j) for i in range(n) for j in range(m)):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                want.append((i, j, d))
        assert sorted(geo.closest_pairs(a, b, ka, kb)) == sorted(want)
    many = rng.random((10_000, 3)) * 100
    keys = [str(i) for i in range(len(many))]
    assert len(geo.closest_pairs(many, many + rng.normal(0, 0.5, many.shape), keys, keys)) == len(many)


def test_grids_and_gates(spark):
    with pytest.raises(ValueError, match="cells"):
        cal.simplex_grid(spark, list("abcdefgh"), units=40)
    assert cal.simplex_grid(spark, ["a", "b", "c"], units=2).count() == 0
    cells = spark.sql("select 's' surface_id, 'autonomy' subject, map('x', 0.25D, 'y', 0.75D) weights union all select 's', 'governance', map('y', 0.75D, 'x', 0.25D)")
    assert len({(r.n, r.sum1, r.sum2) for r in contracts.grid_signatures(cells).collect()}) == 1
    rows = [(i, "geometry", b) for i, b in enumerate([None, "", "[1]", "{}", '{"schema_version":null}', '{"schema_version":0.2}', '{"schema_version":"0.2.12"}', '{"schema_version":"0.2.1"}', "nul"])]
    ok, refused = contracts.gate(spark.createDataFrame([*rows, (9, None, '{"schema_version":"1"}')], "report_id int, kind string, body string"))
    assert [r.report_id for r in ok.collect()] == [6]
    want = {0: "malformed_json", 1: "malformed_json", 2: "not_an_object", 3: "schema_version_missing", 4: "schema_version_missing", 5: "schema_version_missing", 7: "schema_version_unsupported", 8: "malformed_json", 9: "unknown_kind"}
    assert {r.report_id: r.rule for r in refused.collect()} == want


def test_records_are_made_or_refused(spark):
    stamp = "2024-01-01T00:00:00Z"
    row = dict.fromkeys(authority.REQUEST, "x") | {"risk_class": "high", "options": ["a"], "requested_at": stamp, "expires_at": stamp}
    bad = [row | {"approval_id": "p"}, row | {"approval_id": "q", "risk_class": "none", "options": []}, row | {"approval_id": "r", "target": None, "expires_at": "soon"}]
    df = spark.createDataFrame([tuple(x[c] for c in authority.REQUEST) for x in bad], ", ".join(f"{c} {'array<string>' if c == 'options' else 'string'}" for c in authority.REQUEST))
    made, refused = authority.make_requests(df)
    assert [(r.approval_id, r.status) for r in made.collect()] == [("p", "pending")]
    assert {tuple(r) for r in refused.collect()} == {("q", "risk_class_unknown"), ("q", "options_empty"), ("r", "target_missing"), ("r", "expires_at_malformed")}
    assert {r.rule for r in authority.make_requests(df.drop("options"))[1].where("approval_id = 'p'").collect()} == {"options_missing"}
    receipt = spark.createDataFrame([("d", "a", "r", "p", "approve", "o", stamp, 1, -1), ("e", "a", "r", "p", "maybe", "o", stamp, 1, 1)], "decision_id string, approval_id string, run_id string, principal string, decision string, selected_option string, decided_at string, human_active_ms long, human_governance_ms long")
    assert {tuple(r) for r in authority.make_receipts(receipt)[1].collect()} == {("d", "human_time_negative"), ("e", "decision_unknown")}


def test_grid_units_and_weights():
    assert cal.grid_units(0.1, 0.1, 3) == (10, 1) and cal.grid_units(0.05, 0.1, 4) == (20, 2)
    for step, least, n in ((0.3, 0.3, 2), (0.1, 0.15, 2), (0.1, 0.4, 3), (1.0, 0.1, 2), (0.1, 0.0, 2)):
        with pytest.raises(ValueError):
            cal.grid_units(step, least, n)
    assert cal.normalized_weights({"b": 1, "a": 3}, ["a", "b"]) == {"a": 0.75, "b": 0.25}
    for weights in ({"a": 1}, {"a": 1, "b": 0}, {"a": 1, "b": float("nan")}, {}):
        with pytest.raises(ValueError):
            cal.normalized_weights(weights, ["a", "b"])


def test_an_expiry_with_a_grant_takes_no_grant_and_kept_columns_spare_a_join(spark):
    """An expiry that names a grant leaves it to others; outcomes carry their commands' columns, so that a journal reads the log once."""
    at, end = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    rows = [(2 * k, f"a{k}", "enqueue", "r", end, None, None, None, None, None) for k in (0, 1)]
    rows += [(1, "a0", "expire", None, None, None, None, end, "g", None), (3, "a1", "resolve", "r", None, "d", "approve", at, "g", "d")]
    names = "seq long, approval_id string, kind string, run_id string, expires_at timestamp, decision_id string, decision string, at timestamp, authority_ref string, grant_decision_id string"
    log = spark.createDataFrame(rows, names)
    folded = gov.fold_approvals(log, "decision_id", "authority_ref")
    assert {(r.seq, r.outcome, r.status) for r in folded.collect()} == {(0, "accepted", "pending"), (1, "accepted", "expired"), (2, "accepted", "pending"), (3, "accepted", "approved")}
    none = spark.createDataFrame([], "seq long, authority_ref string, kind string, outcome string")
    lean, joined = gov.journal(log, folded, none), gov.journal(log, gov.fold_approvals(log), none)
    assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, joined.collect())) and lean.count() == 6
    joins = [x._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") for x in (lean, joined)]
    assert joins[0] < joins[1]


def test_a_log_is_moved_by_approval_once_after_its_claims_are_settled(spark):
    """What is left of the plan when claims are settled deals the commands once and joins nothing."""
    log = spark.range(40).selectExpr(
        "id seq", "concat('a', id div 4) approval_id", "if(id % 4 = 0, 'enqueue', 'resolve') kind", "'r' run_id", "timestamp'2024-01-02' expires_at", "concat('d', id % 7) decision_id",
        "'approve' decision", "timestamp'2024-01-01' at", "concat('g', id % 5) authority_ref", "concat('d', id % 7) grant_decision_id",
    )
    folded = gov.fold_approvals(log)
    assert folded.where("outcome = 'accepted'").count() > 10
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(approval_id") == 1 and "SortMergeJoin [seq" not in plan
