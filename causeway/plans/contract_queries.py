"""Registered contract checks, with their SQL: reports, snapshots, surfaces and trajectories derived from the tables, with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import contracts
from .derive import table

FAMILIES = ("A", "N", "R")


def _reports(s, d):
    """A report for each order: its kind goes by the clerk's number, versions and bodies are wrong in some."""
    n = F.col("o_orderkey")
    kinds = F.array(*[F.lit(k) for k in [*contracts.VERSIONS, "other"]])
    versions = F.array(*[F.lit(v) for v in [*contracts.VERSIONS.values(), "1"]])
    at = (n % (len(contracts.VERSIONS) + 1) + 1).cast("int")
    version = F.when(n % 11 == 0, "0.1").otherwise(F.element_at(versions, at))
    body = (
        F.when(n % 13 == 0, F.concat(F.lit('{"schema_version":'), n.cast("string"), F.lit("}")))
        .when(n % 17 == 0, F.concat(F.lit('["'), version, F.lit('"]')))
        .when(n % 19 == 0, F.concat(F.lit('{"schema_version":"'), version))
        .when(n % 23 == 0, F.lit('{"total":1}'))
        .otherwise(F.concat(F.lit('{"total":'), n.cast("string"), F.lit(',"schema_version":"'), version, F.lit('"}')))
    )
    return table(s, d, "orders").select(n.alias("report_id"), F.element_at(kinds, at).alias("kind"), body.alias("body"))


def _snapshots(s, d):
    n = F.col("o_orderkey")
    stamp = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return table(s, d, "orders").select(
        F.concat(F.lit("snap:"), n.cast("string")).alias("snapshot_id"),
        F.when(n % 7 == 0, stamp).when(n % 9 == 0, "2024-13-01T00:00:00Z").when(n % 10 == 0, " ").otherwise(F.concat(stamp, F.lit("+00:00"))).alias("observed_at"),
        F.when(n % 12 == 0, "steps").otherwise("interaction_depth").alias("unit"),
        F.when(n % 14 == 0, 1.5).when(n % 4 == 0, 0.8).otherwise(0.9).cast("double").alias("reliability_p"),
        F.when(n % 15 != 0, F.lit("scope")).alias("scope_id"),
        F.lit("method").alias("assessment_method"),
        n.alias("n"),
    )


def _comparisons(s, d):
    """Each order's snapshot against that of the key before; some keys are in no order."""
    n = F.col("o_orderkey")
    snap = lambda c: F.concat(F.lit("snap:"), c.cast("string"))
    pairs = table(s, d, "orders").select(n.alias("comparison_id"), snap(n - 1).alias("base_id"), snap(n).alias("current_id"))
    return contracts.comparison_violations(pairs, _snapshots(s, d))


def _cells(s, d):
    """A surface for each supplier, a cell for each line number, weighted by return flags: its band is of discount or tax."""
    li = table(s, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    per = li.groupBy("l_suppkey", "l_linenumber").agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity").cast("long")).otherwise(0)).alias(f) for f in FAMILIES],
        F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count(F.lit(1)).alias("lines"),
        *[g(F.round(F.col(c) * 100).cast("long")).alias(f"{c[2:]}_{name}") for c in ("l_discount", "l_tax") for g, name in ((F.min, "low"), (F.max, "high"))],
    )
    rows = per.withColumn("subject", F.explode(F.array(F.lit("autonomy"), F.lit("governance"))))
    n, auto = F.col("l_suppkey") * 7 + F.col("l_linenumber"), F.col("subject") == "autonomy"
    low, high = (F.when(auto, F.col(f"discount_{x}")).otherwise(F.col(f"tax_{x}")).cast("double") for x in ("low", "high"))
    weights = F.create_map(*[x for f in FAMILIES for x in (F.lit(f), F.col(f).cast("double") / F.col("q").cast("double") + F.when((n % 29 == 0) & F.lit(f == "A"), 0.5).otherwise(0.0))])
    supported = F.col("lines") > 1
    cells = rows.select(
        F.concat(F.lit("surface:"), F.col("l_suppkey").cast("string")).alias("surface_id"), "subject", F.col("l_linenumber").cast("long").alias("cell_index"),
        F.when(n % 31 == 0, F.map_filter(weights, lambda k, _: k != "R")).otherwise(weights).alias("weights"),
        F.when(supported, "supported").otherwise("thin").alias("support_status"),
        F.when(n % 37 == 0, "unsupported").when(n % 41 == 0, "odd").otherwise("positive_band").alias("sign_class"),
        low.alias("lower"), F.when(n % 43 == 0, high + 1).otherwise((low + high) / 2).alias("median"), F.when(n % 47 != 0, high).alias("upper"),
        F.when(n % 53 != 0, "supported").alias("point_status"), F.when(n % 59 == 0, float("nan")).otherwise(low).alias("point_delta"),
        n.alias("n"),
    )
    return cells.where(~((F.col("n") % 61 == 0) & (F.col("subject") == "governance"))).drop("n")


def _surfaces(s, d):
    n = F.col("s_suppkey")
    return table(s, d, "supplier").select(
        F.concat(F.lit("surface:"), n.cast("string")).alias("surface_id"),
        F.when(n % 5 == 0, "0.2.10").otherwise("0.2.11").alias("schema_version"),
        F.when(n % 6 != 0, contracts.SURFACE_METHOD).alias("method"),
        F.when(n % 7 == 0, F.array(F.lit("A"), F.lit("A"), F.lit("N"))).otherwise(F.array(*map(F.lit, FAMILIES))).alias("families"),
        F.when(n % 8 == 0, 1.0).otherwise(0.1).alias("grid_step"),
    )


def _trajectories(s, d):
    """A trajectory for each customer, an observation for each order in order of its key."""
    n = F.col("o_orderkey")
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    name = lambda tag, c: F.concat(F.lit(tag), c.cast("string"))
    stamp = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return contracts.trajectory_violations(
        table(s, d, "orders").select(
            name("trajectory:", F.col("o_custkey")).alias("trajectory_id"), at.alias("position"),
            F.when(n % 5 == 0, name("shared:", n % 2)).otherwise(name("obs:", n)).alias("observation_id"),
            F.when(n % 11 != 0, F.when(n % 3 == 0, "geo").otherwise(name("geo:", n))).alias("geometry_id"),
            F.when(n % 13 == 0, stamp).otherwise(F.concat(stamp, F.lit("Z"))).alias("observed_at"),
        )
    )


QUERIES = {
    "report_gate": lambda s, d: contracts.gate(_reports(s, d))[1],
    "report_versions": lambda s, d: contracts.gate(_reports(s, d))[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("body", "$.total", "long")).alias("total")),
    "snapshot_contracts": lambda s, d: contracts.snapshot_violations(_snapshots(s, d)),
    "comparison_contracts": _comparisons,
    "surface_contracts": lambda s, d: contracts.surface_violations(_surfaces(s, d), _cells(s, d)),
    "trajectory_contracts": _trajectories,
}

_REPORTS = f"""kinds_v AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate([*contracts.VERSIONS.items(), ("other", "1")]))}) k(i, kind, right_version)),
made_v AS (SELECT o_orderkey AS n, kind, right_version, CASE WHEN o_orderkey % 11 = 0 THEN '0.1' ELSE right_version END AS version FROM orders JOIN kinds_v ON i = o_orderkey % {len(contracts.VERSIONS) + 1}),
body_v AS (SELECT *, CASE WHEN n % 13 = 0 THEN '{{"schema_version":' || n || '}}' WHEN n % 17 = 0 THEN '["' || version || '"]' WHEN n % 19 = 0 THEN '{{"schema_version":"' || version
  WHEN n % 23 = 0 THEN '{{"total":1}}' ELSE '{{"total":' || n || ',"schema_version":"' || version || '"}}' END AS body FROM made_v),
gate_v AS (SELECT *, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' AND json_type(body, '$.schema_version') = 'VARCHAR' THEN json_extract_string(body, '$.schema_version') END AS found FROM body_v),
ruled_v AS (SELECT *, CASE WHEN NOT json_valid(body) THEN 'malformed_json' WHEN json_type(body) <> 'OBJECT' THEN 'not_an_object' WHEN kind = 'other' THEN 'unknown_kind' WHEN found IS NULL THEN 'schema_version_missing'
  WHEN found <> right_version THEN 'schema_version_unsupported' END AS rule FROM gate_v)"""
_SNAPS = """snaps_v AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN o_orderkey % 9 = 0 THEN '2024-13-01T00:00:00Z' WHEN o_orderkey % 10 = 0 THEN ' '
  ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS observed_at, CASE WHEN o_orderkey % 12 = 0 THEN 'steps' ELSE 'interaction_depth' END AS unit,
  CASE WHEN o_orderkey % 14 = 0 THEN 1.5 WHEN o_orderkey % 4 = 0 THEN 0.8 ELSE 0.9 END AS p, CASE WHEN o_orderkey % 15 <> 0 THEN 'scope' END AS scope, o_orderdate AS stamp FROM orders)"""
_CELLS = f"""per_v AS (SELECT l_suppkey AS s, l_linenumber AS i, {", ".join(f"sum(CASE WHEN l_returnflag = '{f}' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS q{f}" for f in FAMILIES)},
  sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS lines, min(CAST(round(l_discount * 100) AS BIGINT)) AS dl, max(CAST(round(l_discount * 100) AS BIGINT)) AS dh,
  min(CAST(round(l_tax * 100) AS BIGINT)) AS tl, max(CAST(round(l_tax * 100) AS BIGINT)) AS th FROM lineitem GROUP BY ALL),
c_v AS (SELECT s, i, subject, s * 7 + i AS n, lines > 1 AS supported, {", ".join(f"CAST(q{f} AS DOUBLE) / CAST(q AS DOUBLE){' + CASE WHEN (s * 7 + i) % 29 = 0 THEN 0.5 ELSE 0 END' if f == 'A' else ''} AS w{f}" for f in FAMILIES)},
  CAST(CASE WHEN subject = 'autonomy' THEN dl ELSE tl END AS DOUBLE) AS low, CAST(CASE WHEN subject = 'autonomy' THEN dh ELSE th END AS DOUBLE) AS high FROM per_v, (VALUES ('autonomy'), ('governance')) x(subject)
  WHERE NOT ((s * 7 + i) % 61 = 0 AND subject = 'governance')),
mix_v AS (SELECT *, 'A=' || CAST(round(wA * 1e9) AS BIGINT) || '|N=' || CAST(round(wN * 1e9) AS BIGINT) || CASE WHEN n % 31 = 0 THEN '' ELSE '|R=' || CAST(round(wR * 1e9) AS BIGINT) END AS mix,
  s % 7 <> 0 AND n % 31 <> 0 AS fits, CASE WHEN n % 43 = 0 THEN high + 1 ELSE (low + high) / 2 END AS mid FROM c_v)"""

ORACLE = {
    "report_gate": f"WITH {_REPORTS} SELECT n AS report_id, rule, found FROM ruled_v WHERE rule IS NOT NULL",
    "report_versions": f"WITH {_REPORTS} SELECT kind, count(*) AS n, CAST(sum(CAST(json_extract(body, '$.total') AS BIGINT)) AS BIGINT) AS total FROM ruled_v WHERE rule IS NULL GROUP BY kind",
    "snapshot_contracts": f"""WITH {_SNAPS} SELECT 'snap:' || n AS snapshot_id, rule FROM snaps_v, LATERAL (SELECT unnest(list_filter([CASE WHEN trim(observed_at) = '' THEN 'observed_at_missing' END,
  CASE WHEN n % 7 = 0 THEN 'observed_at_without_offset' END, CASE WHEN observed_at LIKE '2024-13%' THEN 'observed_at_impossible' END, CASE WHEN unit <> 'interaction_depth' THEN 'unit_unknown' END,
  CASE WHEN p > 1 THEN 'reliability_out_of_range' END, CASE WHEN scope IS NULL THEN 'scope_id_missing' END], lambda x: x IS NOT NULL)) AS rule)""",
    "comparison_contracts": f"""WITH {_SNAPS}, j AS (SELECT c.n AS comparison_id, b.n IS NULL AS gone, b.unit AS bu, c.unit AS cu, b.p AS bp, c.p AS cp, b.scope AS bs, c.scope AS cs,
  coalesce(try_cast(c.observed_at AS TIMESTAMPTZ) < try_cast(b.observed_at AS TIMESTAMPTZ), false) AS early FROM snaps_v c LEFT JOIN snaps_v b ON b.n = c.n - 1)
SELECT comparison_id, rule FROM j, LATERAL (SELECT unnest(list_filter([CASE WHEN gone THEN 'base_unknown' END, CASE WHEN NOT gone AND bu <> cu THEN 'unit_differs' END, CASE WHEN NOT gone AND bp <> cp THEN 'reliability_p_differs' END,
  CASE WHEN NOT gone AND bs IS DISTINCT FROM cs THEN 'scope_id_differs' END, CASE WHEN early THEN 'current_precedes_base' END], lambda x: x IS NOT NULL)) AS rule)""",
    "surface_contracts": f"""WITH {_CELLS}, e AS (SELECT s, subject, i, unnest(list_filter([CASE WHEN NOT fits THEN 'weights_not_of_families' END, CASE WHEN fits AND (wA > 1 + 1e-9 OR wN > 1 + 1e-9 OR wR > 1 + 1e-9) THEN 'weight_out_of_range' END,
  CASE WHEN fits AND wA <= 1 + 1e-9 AND abs(wA + wN + wR - 1) > 1e-9 THEN 'weights_not_one' END, CASE WHEN n % 37 <> 0 AND n % 41 = 0 THEN 'sign_class_invalid' END, CASE WHEN supported AND n % 37 = 0 THEN 'supported_without_class' END,
  CASE WHEN supported AND n % 47 = 0 THEN 'band_missing' END, CASE WHEN supported AND n % 47 <> 0 AND n % 43 = 0 THEN 'band_disordered' END, CASE WHEN supported AND n % 53 = 0 THEN 'point_unsupported' END,
  CASE WHEN supported AND n % 59 = 0 THEN 'point_delta_missing' END], lambda x: x IS NOT NULL)) AS rule FROM mix_v),
t AS (SELECT s, subject, max(i) AS i, 'duplicate_composition' AS rule FROM mix_v GROUP BY s, subject, mix HAVING count(*) > 1),
g AS (SELECT DISTINCT s, mix FROM mix_v WHERE subject = 'autonomy'), h AS (SELECT DISTINCT s, mix FROM mix_v WHERE subject = 'governance'),
b AS (SELECT s, count(DISTINCT subject) AS k FROM mix_v GROUP BY s), differ AS (SELECT DISTINCT s FROM (FROM g EXCEPT FROM h) UNION SELECT DISTINCT s FROM (FROM h EXCEPT FROM g)),
o AS (SELECT s_suppkey AS s, unnest(list_filter([CASE WHEN s_suppkey % 5 = 0 THEN 'schema_version_unsupported' END, CASE WHEN s_suppkey % 6 = 0 THEN 'method_unknown' END, CASE WHEN s_suppkey % 7 = 0 THEN 'families_invalid' END,
  CASE WHEN s_suppkey % 8 = 0 THEN 'grid_step_invalid' END, CASE WHEN coalesce(k, 0) <> 2 THEN 'subjects_invalid' END, CASE WHEN k = 2 AND differ.s IS NOT NULL THEN 'grids_differ' END], lambda x: x IS NOT NULL)) AS rule
  FROM supplier LEFT JOIN b ON b.s = s_suppkey LEFT JOIN differ ON differ.s = s_suppkey)
SELECT 'surface:' || s AS surface_id, subject, CAST(i AS BIGINT) AS cell_index, rule FROM (SELECT s, NULL::VARCHAR AS subject, NULL::BIGINT AS i, rule FROM o UNION ALL SELECT * FROM e UNION ALL SELECT * FROM t)""",
    "trajectory_contracts": """WITH r AS (SELECT o_custkey AS c, row_number() OVER w AS position, o_orderkey AS n, o_orderdate AS made, lag(o_orderdate) OVER w AS made_before,
  CASE WHEN o_orderkey % 5 = 0 THEN 'shared:' || o_orderkey % 2 ELSE 'obs:' || o_orderkey END AS o, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'geo' ELSE 'geo:' || o_orderkey END END AS g
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT c, position, unnest(list_filter([CASE WHEN g IS NULL THEN 'geometry_id_missing' END, CASE WHEN row_number() OVER (PARTITION BY c, o ORDER BY position) > 1 THEN 'duplicate_observation_id' END,
  CASE WHEN g IS NOT NULL AND row_number() OVER (PARTITION BY c, g ORDER BY position) > 1 THEN 'duplicate_geometry_id' END, CASE WHEN n % 13 = 0 THEN 'observed_at_without_offset' END,
  CASE WHEN made <= made_before THEN 'time_not_increasing' END], lambda x: x IS NOT NULL)) AS rule FROM r)
SELECT 'trajectory:' || c AS trajectory_id, position, rule FROM e UNION ALL SELECT 'trajectory:' || o_custkey, NULL, 'too_few_observations' FROM orders GROUP BY o_custkey HAVING count(*) < 3""",
}
