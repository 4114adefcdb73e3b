"""Registered calibration, surface, drift and trajectory queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import keyed_uniform, z_value
from ..functions.lineage import cut
from ..operators import calibration as c
from ..operators import geometry as geo
from .derive import SQL_SNAPSHOTS, SQL_TRIALS, snapshots, trials

FAMILIES = ("A", "N", "R")
REFERENCE = {"A": 0.5, "N": 0.3, "R": 0.2}
#: (observation, target reliability)
TARGETS = ((0, 0.9), (1, 0.85), (2, 0.88))
CONFIDENCE, INTERVAL, MIN_FRACTION, REPLICATES, SEED = 0.9, 0.9, 0.5, 256, "seed"
TAIL = (1 - INTERVAL) / 2
KEYS = ("snapshot_id", "family_id", "subject")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine decimals, minus zero to zero."""
    return df.select(*[(F.round(k, 9) + 0.0).alias(k) if t == "double" else F.col(k) for k, t in df.dtypes])


def _targets(s):
    return s.createDataFrame(list(TARGETS), "obs int, target double")


def _points(s, d):
    return c.points(trials(s, d), *KEYS)


def _curves(s, d):
    return c.curves(_points(s, d), *KEYS)


def _horizons(s, d):
    return c.horizons(_curves(s, d).withColumn("target", F.lit(TARGETS[0][1])))


def _pava(s, d):
    return rounded(_curves(s, d).select(*KEYS, F.inline("pts")).withColumn("depth", F.col("depth").cast("long")))


def _reference(s):
    weights = F.create_map(*[F.lit(x) for kv in REFERENCE.items() for x in kv])
    return s.range(1).select(F.lit("reference").alias("cell"), weights.alias("weights"))


def _observed_mixtures(s, d):
    w = c.observed_weights(_points(s, d), "snapshot_id")
    weights = w.groupBy("snapshot_id", "subject").agg(F.map_from_entries(F.collect_list(F.struct("family_id", "weight"))).alias("weights"))
    return c.mixtures(_curves(s, d).join(weights, ["snapshot_id", "subject"]), None, _targets(s), "snapshot_id")


def _reference_mixtures(s, d):
    return c.mixtures(_curves(s, d), _reference(s), _targets(s), "snapshot_id")


def _mixture_curve(s, d):
    return rounded(_reference_mixtures(s, d).where("obs = 0 and curve is not null").select("snapshot_id", "subject", F.inline("curve")))


def _compare(s, d):
    """Observed, adjusted and residual change of each subject and target."""
    observed = c.deltas(_observed_mixtures(s, d), "subject", "obs").select("subject", "obs", F.col("delta").alias("observed_delta"), F.col("reasons").alias("observed_reasons"))
    adjusted = c.deltas(_reference_mixtures(s, d), "subject", "obs").select("subject", "obs", F.col("delta").alias("adjusted_delta"), F.col("reasons").alias("adjusted_reasons"))
    out = observed.join(adjusted, ["subject", "obs"]).withColumn("residual", F.col("observed_delta") - F.col("adjusted_delta"))
    w = c.observed_weights(_points(s, d), "snapshot_id").select("subject", "family_id", "snapshot_id", "weight")
    tv = (
        w.groupBy("subject", "family_id")
        .agg(F.abs(F.sum(F.when(F.col("snapshot_id") == "base", F.col("weight")).otherwise(-F.col("weight")))).alias("moved"))
        .groupBy("subject")
        .agg((F.sum("moved") / 2).alias("composition_tv"))
    )
    return rounded(out.join(tv, "subject"))


def _family_deltas(s, d):
    return rounded(c.family_deltas(_horizons(s, d)))


def _agreement(s, d):
    adjusted = c.deltas(_reference_mixtures(s, d).where("obs = 0"), "subject").withColumnRenamed("delta", "adjusted_delta")
    return rounded(c.agreement(c.family_deltas(_horizons(s, d)), adjusted, c.context(snapshots(s, d))).drop("elapsed_days"))


def reference_assessment(s, d):
    """One row: the horizons of the current snapshot under the reference weights, with the contract that they are measured by."""
    current = _reference_mixtures(s, d).where("snapshot_id = 'current' and obs = 0")
    return rounded(c.assessment(current, "snapshot_id")).select(
        F.concat(F.lit("assessment:"), "snapshot_id").alias("assessment_id"),
        F.lit("interaction_depth").alias("unit"),
        F.lit(TARGETS[0][1]).alias("reliability_p"),
        F.lit("reference_mixture").alias("scope_id"),
        F.lit("isotonic_mixture").alias("assessment_method"),
        "h_autonomy",
        "h_governance",
    )


def _uniforms(s, d):
    t = trials(s, d)
    u = keyed_uniform(F.lit(SEED), *[F.col(k).cast("string") for k in ("snapshot_id", "family_id", "subject", "depth")])
    return t.select(*KEYS, "depth", u.alias("u"))


def _resampled(s, d, replicates=REPLICATES):
    return c.resample(_points(s, d), SEED, replicates)


def _replicate_curves(pts, replicates=REPLICATES):
    """Curves of the point estimate (rep -1) and of every replicate."""
    point = pts.select(F.lit(-1).alias("rep"), *KEYS, "depth", "trials", "successes")
    return c.curves(c.by_replicate(point.union(c.resample(pts, SEED, replicates))), "rep", *KEYS)


def _deltas(s, d, replicates=REPLICATES):
    """Change of every replicate (-1: the point estimate), observation and grid cell: one plan over a widened key."""
    curves = _replicate_curves(cut(_points(s, d)), replicates)
    grid = c.simplex_grid(s, FAMILIES).select("cell", "weights")
    return c.deltas(c.mixtures(curves, grid, _targets(s), "rep", "snapshot_id"), "rep", "obs", "cell", "subject")


def _scan(s, d):
    curves = _curves(s, d)
    grid = c.simplex_grid(s, FAMILIES).select("cell", "weights")
    return c.deltas(c.mixtures(curves, grid, _targets(s), "snapshot_id"), "obs", "cell", "subject")


def _sensitivity(s, d):
    """Least and greatest change over the grid and where; the first cell in grid order on ties."""
    lo, hi = F.min_by("cell", F.struct("delta", "cell")), F.max_by("cell", F.struct(F.col("delta"), -F.col("rank")))
    from pyspark.sql.window import Window

    ranked = _scan(s, d).where("delta is not null").withColumn("rank", F.row_number().over(Window.partitionBy("obs", "subject").orderBy("cell")))
    return rounded(
        ranked.groupBy("obs", "subject").agg(
            F.count(F.lit(1)).alias("n_supported"),
            F.min("delta").alias("least"),
            lo.alias("least_cell"),
            F.max("delta").alias("greatest"),
            hi.alias("greatest_cell"),
            (F.max("delta") - F.min("delta")).alias("span"),
        )
    )


def _bands(s, d):
    """Bands of the change under the reference weights."""
    curves = _replicate_curves(cut(_points(s, d)))
    mixed = c.deltas(c.mixtures(curves, _reference(s), _targets(s), "rep", "snapshot_id"), "rep", "obs", "subject")
    return rounded(c.bands(mixed.where("rep >= 0"), "delta", ["obs", "subject"], REPLICATES, INTERVAL, MIN_FRACTION))


def _faulty_trials(s, d):
    """The trials, with more successes than trials or no trials at some depths."""
    depth = F.col("depth")
    return trials(s, d).withColumns(
        {"successes": F.when(depth % 4 == 0, F.col("trials") + 1).otherwise(F.col("successes")), "trials": F.when(depth % 5 == 0, 0).otherwise(F.col("trials"))}
    )


def _scalars(s, d):
    """Bands of all numbers of the comparison at the first target: horizons, changes, the residual, and each family's change."""
    pts = cut(_points(s, d))
    # two mixtures and the families read the curves: they are fitted once
    curves = cut(_replicate_curves(pts))
    target = s.createDataFrame([TARGETS[0]], "obs int, target double")
    w = c.observed_weights(pts, "snapshot_id")
    own = w.groupBy("snapshot_id", "subject").agg(F.map_from_entries(F.collect_list(F.struct("family_id", "weight"))).alias("weights"))
    observed = c.mixtures(curves.join(F.broadcast(own), ["snapshot_id", "subject"]), None, target, "rep", "snapshot_id")
    reference = c.mixtures(curves, _reference(s), target, "rep", "snapshot_id")
    families = c.horizons(curves.withColumn("target", F.lit(TARGETS[0][1])))
    values = c.comparison_scalars(observed, reference, families, "rep").where("rep >= 0")
    return rounded(c.bands(values, "value", ["subject", "scalar"], REPLICATES, INTERVAL, MIN_FRACTION))


def surface(s, d, replicates=REPLICATES):
    moved = _deltas(s, d, replicates)
    band = c.bands(moved.where("rep >= 0"), "delta", ["obs", "subject", "cell"], replicates, INTERVAL, MIN_FRACTION)
    point = moved.where("rep = -1").select("obs", "subject", "cell", "delta")
    grid = c.simplex_grid(s, FAMILIES).select("cell", "units")
    out = band.join(point, ["obs", "subject", "cell"]).join(F.broadcast(grid), "cell")
    supported = F.col("supported") & F.col("delta").isNotNull()
    made = out.withColumn("supported", supported).withColumn(
        "sign_class", c.sign_class(F.col("lower"), F.col("upper"), F.col("supported"))
    )
    return rounded(made)


def _reason_counts(s, d):
    """How often each status stands against a replicate's cell."""
    each = _deltas(s, d).where("rep >= 0 and reasons <> ''").select("obs", "subject", F.explode(F.split("reasons", ";")).alias("reason"))
    return each.groupBy("obs", "subject", "reason").agg(F.count(F.lit(1)).alias("n"))


def _axes(s, d):
    """Which moves the change more: the choice of mixture or sampling."""
    span = _sensitivity(s, d).select("obs", "subject", "span")
    width = _bands(s, d).select("obs", "subject", (F.col("upper") - F.col("lower")).alias("width"))
    larger = (
        F.when(F.col("span").isNull() | F.col("width").isNull(), "unavailable")
        .when(F.abs(F.col("span") - F.col("width")) <= 1e-9, "equal")
        .when(F.col("span") > F.col("width"), "mixture_choice")
        .otherwise("sampling")
    )
    joined = width.join(span, ["obs", "subject"], "left")
    return rounded(joined.select("obs", "subject", "span", "width", F.when(F.col("width") != 0, F.col("span") / F.col("width")).alias("ratio"), larger.alias("larger_axis")))


def _geometry(f):
    def query(s, d):
        # a surface has as many rows as its grid and is read several times: it is written once
        return f(cut(surface(s, d)))

    return query


QUERIES = {
    "cal_points": _points,
    "cal_wilson": lambda s, d: rounded(c.intervals(_points(s, d), CONFIDENCE)),
    "cal_pava": _pava,
    "cal_horizon": lambda s, d: rounded(_horizons(s, d).select(*KEYS, "status", "evidence_reasons", "horizon")),
    "cal_assessment": lambda s, d: rounded(c.assessment(_horizons(s, d), "snapshot_id", "family_id")),
    "snap_weights": lambda s, d: rounded(c.observed_weights(_points(s, d), "snapshot_id")),
    "mixture_curve": _mixture_curve,
    "mixture_horizon": lambda s, d: rounded(_reference_mixtures(s, d).select("snapshot_id", "subject", "obs", "status", "horizon")),
    "snapshot_compare": _compare,
    "family_deltas": _family_deltas,
    "family_agreement": _agreement,
    "snapshot_context": lambda s, d: rounded(c.context(snapshots(s, d))),
    "bootstrap_uniform": _uniforms,
    "bootstrap_successes": _resampled,
    "bootstrap_bands": _bands,
    "bootstrap_scalars": _scalars,
    "simplex_grid": lambda s, d: c.simplex_grid(s, FAMILIES).select("cell", F.array_join(F.transform("units", lambda u: u.cast("string")), ",").alias("units")),
    "mixture_scan": lambda s, d: rounded(_scan(s, d)),
    "sensitivity_range": _sensitivity,
    "joint_surface": lambda s, d: surface(s, d).drop("units", "supported_replicates"),
    "surface_summary": _geometry(lambda x: rounded(geo.summary(x))),
    "surface_edges": _geometry(lambda x: geo.edges(x).select("obs", "subject", "cell_a", "cell_b")),
    "surface_components": _geometry(geo.components),
    "sign_regions": _geometry(lambda x: geo.components(x, by_sign=True)),
    "evidence_checks": lambda s, d: c.evidence_violations(_faulty_trials(s, d), *KEYS),
    "class_turnover": _geometry(geo.class_turnover),
    "surface_isolated": _geometry(geo.isolated),
    "support_boundary": _geometry(geo.support_boundary),
    "sign_boundary": _geometry(geo.sign_boundary),
    "surface_gradients": _geometry(lambda x: rounded(geo.gradients(x))),
    "surface_crossings": _geometry(lambda x: rounded(geo.crossings(x).drop("at"))),
    "domain_motion": _geometry(lambda x: rounded(geo.domain_motion(x))),
    "sign_migration": _geometry(geo.sign_migration),
    "component_motion": _geometry(geo.component_motion),
    "boundary_match": _geometry(lambda x: geo.greedy_matches(geo.crossings(x))),
    "gradient_drift": _geometry(lambda x: rounded(geo.gradient_drift(x))),
    "support_trajectory": _geometry(geo.support_trajectory),
    "sign_persistence": _geometry(geo.sign_persistence),
    "gradient_trajectory": _geometry(lambda x: rounded(geo.gradient_trajectory(x))),
    "reason_counts": _reason_counts,
    "axis_comparison": _axes,
    "frontier_motion": _geometry(geo.frontier_motion),
    "component_lineage": _geometry(geo.component_lineages),
    "boundary_motion": _geometry(lambda x: rounded(geo.boundary_motion(geo.greedy_matches(geo.crossings(x)), 30.0))),
    "boundary_lineage": _geometry(lambda x: geo.boundary_lineages(geo.greedy_matches(geo.crossings(x)), geo.crossings(x))),
}


def _r(x: str) -> str:
    return f"(round({x}, 9) + 0.0::DOUBLE)"


_OBS = ", ".join(f"({o}, {t}::DOUBLE)" for o, t in TARGETS)
_POINT = "reps_v AS (SELECT -1 AS rep, * FROM trials_v)"
_RESAMPLED = f"""
draws_v AS (SELECT r.rep, t.*, unnest(range(t.trials)) AS attempt FROM trials_v t, range({REPLICATES}) r(rep) WHERE successes > 0 AND successes < trials),
boot_v AS (SELECT rep, snapshot_id, family_id, subject, depth, trials, successes FROM trials_v t, range({REPLICATES}) r(rep) WHERE successes = 0 OR successes = trials
  UNION ALL SELECT rep, snapshot_id, family_id, subject, depth, max(trials), count(*) FILTER (
    CAST(CAST('0x' || sha256(concat_ws(chr(31), '{SEED}', snapshot_id, rep, family_id, subject, depth, attempt))[1:13] AS BIGINT) AS DOUBLE) / pow(2, 52) < CAST(successes AS DOUBLE) / trials)
  FROM draws_v GROUP BY ALL)"""
_FIT = """
p_v AS (SELECT *, row_number() OVER w AS i, CAST(sum(trials) OVER w AS BIGINT) AS ct, CAST(sum(successes) OVER w AS BIGINT) AS cs FROM reps_v
  WINDOW w AS (PARTITION BY rep, snapshot_id, family_id, subject ORDER BY depth)),
ab_v AS (SELECT x.rep, x.snapshot_id, x.family_id, x.subject, x.i, a.i AS a, max(CAST(b.cs - a.cs + a.successes AS DOUBLE) / CAST(b.ct - a.ct + a.trials AS DOUBLE)) AS m
  FROM p_v x JOIN p_v a USING (rep, snapshot_id, family_id, subject) JOIN p_v b USING (rep, snapshot_id, family_id, subject) WHERE a.i <= x.i AND b.i >= x.i GROUP BY ALL),
fit_v AS (SELECT p_v.*, f.fit FROM p_v JOIN (SELECT rep, snapshot_id, family_id, subject, i, min(m) AS fit FROM ab_v GROUP BY ALL) f USING (rep, snapshot_id, family_id, subject, i))"""
_MIX = f"""
obs_v(obs, target) AS (VALUES {_OBS}),
fam_v AS (SELECT rep, snapshot_id, family_id, subject, obs, target, min(depth) AS lo, max(depth) AS hi, bool_and(fit >= target) OR bool_and(fit < target) AS bad FROM fit_v, obs_v GROUP BY ALL),
sup_v AS (SELECT rep, snapshot_id, subject, obs, target, string_agg('family_unsupported:' || family_id, ',' ORDER BY family_id) FILTER (bad) AS refused, max(lo) AS low, min(hi) AS high FROM fam_v GROUP BY ALL),
dep_v AS (SELECT DISTINCT rep, snapshot_id, subject, obs, target, depth FROM sup_v JOIN fit_v USING (rep, snapshot_id, subject) WHERE refused IS NULL AND low < high AND depth BETWEEN low AND high),
lh_v AS (SELECT d.rep, d.snapshot_id, d.subject, d.obs, d.target, d.depth, f.family_id, max(f.depth) FILTER (f.depth <= d.depth) AS ld, arg_max(f.fit, f.depth) FILTER (f.depth <= d.depth) AS lf,
  min(f.depth) FILTER (f.depth >= d.depth) AS hd, arg_min(f.fit, f.depth) FILTER (f.depth >= d.depth) AS hf FROM dep_v d JOIN fit_v f USING (rep, snapshot_id, subject) GROUP BY ALL),
int_v AS (SELECT *, CASE WHEN ld = hd THEN lf ELSE lf + CAST(depth - ld AS DOUBLE) / (hd - ld) * (hf - lf) END AS p FROM lh_v),
prob_v AS (SELECT int_v.rep, int_v.snapshot_id, int_v.subject, obs, target, cell, depth, sum(weight * p ORDER BY int_v.family_id) AS p FROM int_v JOIN weights_v w ON w.family_id = int_v.family_id
  AND (w.snapshot_id IS NULL OR (w.snapshot_id = int_v.snapshot_id AND w.subject = int_v.subject)) GROUP BY ALL),
lead_v AS (SELECT *, lead(p) OVER w AS q, lead(depth) OVER w AS e FROM prob_v WINDOW w AS (PARTITION BY rep, snapshot_id, subject, obs, cell ORDER BY depth)),
cross_v AS (SELECT rep, snapshot_id, subject, obs, cell, bool_and(p >= target) AS hi, bool_and(p < target) AS lo, arg_min(CASE WHEN p = target THEN CAST(depth AS DOUBLE)
  ELSE depth + (p - target) / (p - q) * (e - depth) END, depth) FILTER (p >= target AND q < target) AS h FROM lead_v GROUP BY ALL),
mix_v AS (SELECT s.rep, s.snapshot_id, s.subject, s.obs, c.cell, CASE WHEN refused IS NOT NULL THEN refused WHEN low >= high THEN 'no_common_depth_support' WHEN hi THEN 'target_not_bracketed_high'
  WHEN lo THEN 'target_not_bracketed_low' WHEN h IS NULL THEN 'target_not_bracketed_in_common_support' ELSE 'supported' END AS status, h AS horizon
  FROM sup_v s CROSS JOIN (SELECT DISTINCT cell FROM weights_v) c LEFT JOIN cross_v x ON x.rep = s.rep AND x.snapshot_id = s.snapshot_id AND x.subject = s.subject AND x.obs = s.obs AND x.cell = c.cell),
delta_v AS (SELECT rep, obs, cell, subject, max(horizon) FILTER (snapshot_id = 'base') AS base_horizon, max(horizon) FILTER (snapshot_id = 'current') AS current_horizon,
  coalesce(array_to_string(list_sort(list(DISTINCT snapshot_id || ':' || status) FILTER (status <> 'supported')), ';'), '') AS reasons,
  max(horizon) FILTER (snapshot_id = 'current') - max(horizon) FILTER (snapshot_id = 'base') AS delta FROM mix_v GROUP BY ALL)"""
_REF = "weights_v AS (SELECT 'reference' AS cell, NULL AS snapshot_id, NULL AS subject, family_id, weight FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in REFERENCE.items()) + ") t(family_id, weight))"
#: autonomy_gap of one row, as reference_assessment gives it.
SQL_GAP = f"""gap_v AS (WITH {SQL_TRIALS}, {_POINT}, {_FIT}, {_REF}, {_MIX}
  SELECT {_r("max(horizon) FILTER (subject = 'autonomy')")} - {_r("max(horizon) FILTER (subject = 'governance')")} AS autonomy_gap FROM mix_v WHERE snapshot_id = 'current' AND obs = 0)"""
_GRID = """grid_v AS (SELECT lpad(CAST(a AS VARCHAR), 2, '0') || '-' || lpad(CAST(n AS VARCHAR), 2, '0') || '-' || lpad(CAST(10 - a - n AS VARCHAR), 2, '0') AS cell, a, n, 10 - a - n AS r
  FROM range(1, 9) x(a), range(1, 9) y(n) WHERE 10 - a - n >= 1)"""
_GRIDW = f"""{_GRID}, weights_v AS (SELECT cell, NULL AS snapshot_id, NULL AS subject, 'A' AS family_id, a / 10.0::DOUBLE AS weight FROM grid_v
  UNION ALL SELECT cell, NULL, NULL, 'N', n / 10.0::DOUBLE FROM grid_v UNION ALL SELECT cell, NULL, NULL, 'R', r / 10.0::DOUBLE FROM grid_v)"""
_SHARE = "share_v AS (SELECT snapshot_id, subject, family_id, CAST(sum(trials) AS BIGINT) AS mass, CAST(sum(trials) AS DOUBLE) / any_value(total) AS weight FROM (SELECT *, CAST(sum(trials) OVER (PARTITION BY snapshot_id, subject) AS DOUBLE) AS total FROM trials_v) GROUP BY snapshot_id, subject, family_id)"
_OWN = f"{_SHARE}, weights_v AS (SELECT 'own' AS cell, snapshot_id, subject, family_id, weight FROM share_v)"


def _q(q: float) -> str:
    return f"(v[CAST(floor((len(v) - 1) * {q!r}::DOUBLE) AS INT) + 1] + ((len(v) - 1) * {q!r}::DOUBLE - floor((len(v) - 1) * {q!r}::DOUBLE)) * (v[CAST(ceil((len(v) - 1) * {q!r}::DOUBLE) AS INT) + 1] - v[CAST(floor((len(v) - 1) * {q!r}::DOUBLE) AS INT) + 1]))"


def _share(cond: str) -> str:
    return f"CASE WHEN len(v) > 0 THEN len(list_filter(v, lambda x: {cond})) / CAST(len(v) AS DOUBLE) END"


def _band_cols() -> str:
    return f"""CAST(len(v) AS BIGINT) AS supported_replicates, len(v) / {REPLICATES}.0::DOUBLE AS supported_fraction, ok AS supported,
  {_r(f'CASE WHEN ok THEN {_q(TAIL)} END')} AS lower, {_r(f'CASE WHEN ok THEN {_q(0.5)} END')} AS median, {_r(f'CASE WHEN ok THEN {_q(1 - TAIL)} END')} AS upper,
  {_r('CASE WHEN ok THEN list_sum(v) / len(v) END')} AS mean, {_r(_share('x > 1e-12'))} AS positive_share, {_r(_share('x < -1e-12'))} AS negative_share, {_r(_share('abs(x) <= 1e-12'))} AS zero_share"""


_ALL = f"{_RESAMPLED}, reps_v AS (SELECT -1 AS rep, * FROM trials_v UNION ALL SELECT * FROM boot_v), {_FIT}"
_SURFACE = f"""{SQL_TRIALS}, {_ALL}, {_GRIDW}, {_MIX},
vals_v AS (SELECT obs, subject, cell, coalesce(list_sort(list(delta) FILTER (delta IS NOT NULL)), []) AS v FROM delta_v WHERE rep >= 0 GROUP BY ALL),
okv AS (SELECT *, len(v) > 0 AND len(v) / {REPLICATES}.0::DOUBLE >= {MIN_FRACTION} AS ok FROM vals_v),
band_v AS (SELECT obs, subject, cell, {_band_cols()} FROM okv),
surf_v AS (SELECT b.* EXCLUDE (supported), {_r('p.delta')} AS delta, b.supported AND p.delta IS NOT NULL AS supported, CASE WHEN NOT (b.supported AND p.delta IS NOT NULL) THEN 'unsupported' WHEN lower > 1e-12 THEN 'positive_band'
  WHEN upper < -1e-12 THEN 'negative_band' WHEN abs(lower) <= 1e-12 AND abs(upper) <= 1e-12 THEN 'zero_band' ELSE 'crosses_zero' END AS sign_class, g.a, g.n, g.r
  FROM band_v b JOIN (SELECT * FROM delta_v WHERE rep = -1) p USING (obs, subject, cell) JOIN grid_v g USING (cell)),
surface_v AS MATERIALIZED (SELECT * FROM surf_v),
edge_v AS (SELECT x.obs, x.subject, x.cell AS cell_a, y.cell AS cell_b, x.supported AS sa, y.supported AS sb, x.sign_class AS ca, y.sign_class AS cb, x.lower AS la, y.lower AS lb, x.upper AS ua, y.upper AS ub,
  x.delta AS da, y.delta AS db FROM surface_v x JOIN surface_v y ON x.obs = y.obs AND x.subject = y.subject AND x.cell < y.cell AND abs(x.a - y.a) + abs(x.n - y.n) + abs(x.r - y.r) = 2),
cr_v AS (SELECT obs, subject, 'lower' AS field, cell_a, cell_b, la AS va, lb AS vb FROM edge_v WHERE sa AND sb AND (la > 1e-12) <> (lb > 1e-12)
  UNION ALL SELECT obs, subject, 'upper', cell_a, cell_b, ua, ub FROM edge_v WHERE sa AND sb AND (ua < -1e-12) <> (ub < -1e-12)),
crossing_v AS (SELECT * EXCLUDE (va, vb), CASE WHEN abs(va) <= 1e-12 THEN 0.0::DOUBLE WHEN abs(vb) <= 1e-12 THEN 1.0 WHEN va * vb < 0 THEN -va / (vb - va) END AS fraction FROM cr_v
  WHERE abs(va) <= 1e-12 OR abs(vb) <= 1e-12 OR va * vb < 0),
grad_v AS (SELECT obs, subject, cell_a, cell_b, (db - da) / 0.1::DOUBLE AS delta_slope, (lb - la) / 0.1::DOUBLE AS lower_slope, (ub - ua) / 0.1::DOUBLE AS upper_slope FROM edge_v WHERE sa AND sb),
step_v AS (SELECT coalesce(x.obs, y.obs - 1) AS step, coalesce(x.subject, y.subject) AS subject, coalesce(x.cell, y.cell) AS cell, coalesce(x.supported, false) AS was, coalesce(y.supported, false) AS now,
  coalesce(x.sign_class, 'unsupported') AS from_class, coalesce(y.sign_class, 'unsupported') AS to_class FROM surface_v x JOIN surface_v y ON y.obs = x.obs + 1 AND y.subject = x.subject AND y.cell = x.cell)"""


def _comp(sign: bool) -> str:
    g = "sign_class" if sign else "'supported'"
    same = " AND ca = cb" if sign else ""
    return f"""
link_v AS (SELECT obs, subject, cell_a AS a, cell_b AS b FROM edge_v WHERE sa AND sb{same} UNION ALL SELECT obs, subject, cell_b, cell_a FROM edge_v WHERE sa AND sb{same}),
reach_v AS (SELECT obs, subject, cell AS a, cell AS b FROM surface_v WHERE supported UNION SELECT r.obs, r.subject, r.a, l.b FROM reach_v r JOIN link_v l ON l.obs = r.obs AND l.subject = r.subject AND l.a = r.b),
root_v AS (SELECT obs, subject, a AS cell, min(b) AS root FROM reach_v GROUP BY ALL),
comp_v AS (SELECT obs, subject, {g} AS grp, cell, CAST(dense_rank() OVER (PARTITION BY obs, subject, {g} ORDER BY root) - 1 AS BIGINT) AS component FROM root_v JOIN surface_v USING (obs, subject, cell))"""


_KEYS = "snapshot_id, family_id, subject"
_HZ = f"""{SQL_TRIALS}, {_POINT}, {_FIT},
hl_v AS (SELECT *, lead(fit) OVER w AS q, lead(depth) OVER w AS e FROM fit_v WINDOW w AS (PARTITION BY {_KEYS} ORDER BY depth)),
hz_v AS (SELECT {_KEYS}, count(*) AS k, sum(trials) AS t, bool_and(fit >= 0.9::DOUBLE) AS hi, bool_and(fit < 0.9::DOUBLE) AS lo, arg_min(CASE WHEN fit = 0.9::DOUBLE THEN CAST(depth AS DOUBLE)
  ELSE depth + (fit - 0.9::DOUBLE) / (fit - q) * (e - depth) END, depth) FILTER (fit >= 0.9::DOUBLE AND q < 0.9::DOUBLE) AS h FROM hl_v GROUP BY ALL),
hs_v AS (SELECT {_KEYS}, concat_ws(',', CASE WHEN k < 3 THEN 'insufficient_distinct_depths' END, CASE WHEN t < 10 THEN 'insufficient_total_trials' END) AS evidence_reasons, hi, lo, h FROM hz_v),
horizon_v AS (SELECT {_KEYS}, CASE WHEN evidence_reasons <> '' THEN 'insufficient_evidence' WHEN hi THEN 'target_not_bracketed_high' WHEN lo THEN 'target_not_bracketed_low' ELSE 'supported' END AS status,
  evidence_reasons, CASE WHEN evidence_reasons = '' THEN h END AS horizon FROM hs_v)"""
_Z = repr(z_value(CONFIDENCE)) + "::DOUBLE"

ORACLE = {
    "cal_points": f"WITH {SQL_TRIALS} SELECT {_KEYS}, depth, trials, successes FROM trials_v",
    "cal_wilson": f"""WITH {SQL_TRIALS}, w AS (SELECT *, CAST(successes AS DOUBLE) / trials AS p, CAST(trials AS DOUBLE) AS t, {_Z} AS z FROM trials_v),
x AS (SELECT *, 1 + z * z / t AS s, (p + z * z / (2 * t)) / (1 + z * z / t) AS c, z * sqrt(p * (1 - p) / t + z * z / (4 * t * t)) / (1 + z * z / t) AS h FROM w)
SELECT {_KEYS}, depth, trials, successes, {_r('p')} AS rate, {_r('greatest(0, c - h)')} AS wilson_lower, {_r('least(1, c + h)')} AS wilson_upper FROM x""",
    "cal_pava": f"WITH {SQL_TRIALS}, {_POINT}, {_FIT} SELECT {_KEYS}, depth, trials, successes, {_r('fit')} AS fit FROM fit_v",
    "cal_horizon": f"WITH {_HZ} SELECT {_KEYS}, status, evidence_reasons, {_r('horizon')} AS horizon FROM horizon_v",
    "cal_assessment": f"""WITH {_HZ}, a AS (SELECT snapshot_id, family_id, max(horizon) FILTER (subject = 'autonomy') AS ha, max(horizon) FILTER (subject = 'governance') AS hg FROM horizon_v GROUP BY ALL)
SELECT snapshot_id, family_id, {_r('ha')} AS h_autonomy, {_r('hg')} AS h_governance, {_r('ha - hg')} AS gap, {_r('-(ha - hg)')} AS margin FROM a""",
    "snap_weights": f"WITH {SQL_TRIALS}, {_SHARE} SELECT snapshot_id, subject, family_id, mass, {_r('weight')} AS weight FROM share_v",
    "mixture_curve": f"WITH {SQL_TRIALS}, {_POINT}, {_FIT}, {_REF}, {_MIX} SELECT snapshot_id, subject, CAST(depth AS DOUBLE) AS depth, {_r('p')} AS p FROM prob_v WHERE obs = 0",
    "mixture_horizon": f"WITH {SQL_TRIALS}, {_POINT}, {_FIT}, {_REF}, {_MIX} SELECT snapshot_id, subject, obs, status, {_r('horizon')} AS horizon FROM mix_v",
    "snapshot_compare": f"""WITH o AS (WITH {SQL_TRIALS}, {_POINT}, {_FIT}, {_OWN}, {_MIX} SELECT * FROM delta_v), r AS (WITH {SQL_TRIALS}, {_POINT}, {_FIT}, {_REF}, {_MIX} SELECT * FROM delta_v),
{SQL_TRIALS}, {_SHARE}, m AS (SELECT subject, family_id, abs(sum(CASE snapshot_id WHEN 'base' THEN weight ELSE -weight END)) AS moved FROM share_v GROUP BY ALL), t AS (SELECT subject, sum(moved) / 2 AS tv FROM m GROUP BY ALL)
SELECT subject, o.obs, {_r('o.delta')} AS observed_delta, o.reasons AS observed_reasons, {_r('r.delta')} AS adjusted_delta, r.reasons AS adjusted_reasons, {_r('o.delta - r.delta')} AS residual, {_r('tv')} AS composition_tv
FROM o JOIN r USING (subject, obs) JOIN t USING (subject)""",
    "family_deltas": f"""WITH {_HZ}, d AS (SELECT family_id, subject, max(horizon) FILTER (snapshot_id = 'base') AS b, max(horizon) FILTER (snapshot_id = 'current') AS c,
  coalesce(max(status) FILTER (snapshot_id = 'base'), 'missing_family') AS base_status, coalesce(max(status) FILTER (snapshot_id = 'current'), 'missing_family') AS current_status,
  FROM horizon_v GROUP BY ALL)
SELECT family_id, subject, {_r('b')} AS base_horizon, {_r('c')} AS current_horizon, base_status, current_status,
  concat_ws(';', CASE WHEN base_status <> 'supported' THEN 'base:' || base_status END, CASE WHEN current_status <> 'supported' THEN 'current:' || current_status END) AS reasons,
  {_r('c - b')} AS delta, CAST(CASE WHEN c - b > 1e-12 THEN 1 WHEN c - b < -1e-12 THEN -1 WHEN c - b IS NOT NULL THEN 0 END AS INT) AS direction FROM d""",
    "family_agreement": f"""WITH a AS (WITH {SQL_TRIALS}, {_POINT}, {_FIT}, {_REF}, {_MIX} SELECT subject, delta AS adjusted FROM delta_v WHERE obs = 0), {SQL_SNAPSHOTS}, {_HZ},
d AS (SELECT family_id, subject, max(horizon) FILTER (snapshot_id = 'base') AS b, max(horizon) FILTER (snapshot_id = 'current') AS c FROM horizon_v GROUP BY ALL),
x AS (SELECT *, CASE WHEN c - b > 1e-12 THEN 1 WHEN c - b < -1e-12 THEN -1 WHEN c - b IS NOT NULL THEN 0 END AS way, CASE WHEN adjusted > 1e-12 THEN 1 WHEN adjusted < -1e-12 THEN -1 WHEN adjusted IS NOT NULL THEN 0 END AS expected FROM d LEFT JOIN a USING (subject))
SELECT subject, {_r('max(adjusted)')} AS adjusted_delta, {_r('count(c - b) / count(*)::DOUBLE')} AS supported_fraction, {_r('avg(CAST(way = expected AS DOUBLE))')} AS direction_agreement,
  {_r('min(b)')} AS base_least, {_r('max(b)')} AS base_greatest, {_r('min(c)')} AS current_least, {_r('max(c)')} AS current_greatest, {_r('max(abs(c - b))')} AS max_abs_delta,
  {_r('max(CASE WHEN days > 0 THEN adjusted / days END)')} AS per_day FROM x CROSS JOIN context_v GROUP BY subject""",
    "snapshot_context": f"""WITH {SQL_SNAPSHOTS} SELECT false AS backend_changed, false AS benchmark_version_changed, config_changed AS agent_config_changed, families_changed AS family_set_changed,
  {_r('days')} AS elapsed_days, CASE WHEN config_changed OR families_changed THEN 'mixed_configuration_change' ELSE 'longitudinal_same_configuration' END AS comparison_kind,
  CASE WHEN days < 0 THEN 'current_precedes_base' END AS violation FROM context_v""",
    "bootstrap_uniform": f"""WITH {SQL_TRIALS} SELECT {_KEYS}, depth, CAST(CAST('0x' || sha256(concat_ws(chr(31), '{SEED}', snapshot_id, family_id, subject, depth))[1:13] AS BIGINT) AS DOUBLE) / pow(2, 52) AS u FROM trials_v""",
    "bootstrap_successes": f"WITH {SQL_TRIALS}, {_RESAMPLED} SELECT CAST(rep AS INT) AS rep, {_KEYS}, depth, trials, successes FROM boot_v",
    "bootstrap_bands": f"""WITH {SQL_TRIALS}, {_ALL}, {_REF}, {_MIX}, vals_v AS (SELECT obs, subject, coalesce(list_sort(list(delta) FILTER (delta IS NOT NULL)), []) AS v FROM delta_v WHERE rep >= 0 GROUP BY ALL),
okv AS (SELECT *, len(v) > 0 AND len(v) / {REPLICATES}.0::DOUBLE >= {MIN_FRACTION} AS ok FROM vals_v) SELECT obs, subject, {_band_cols()} FROM okv""",
    "bootstrap_scalars": f"""WITH o AS (WITH {SQL_TRIALS}, {_ALL}, {_OWN}, {_MIX} SELECT * FROM delta_v WHERE obs = 0), r AS (WITH {SQL_TRIALS}, {_ALL}, {_REF}, {_MIX} SELECT * FROM delta_v WHERE obs = 0),
h AS (WITH {SQL_TRIALS}, {_ALL}, l AS (SELECT *, lead(fit) OVER w AS q, lead(depth) OVER w AS e FROM fit_v WINDOW w AS (PARTITION BY rep, {_KEYS} ORDER BY depth))
  SELECT rep, {_KEYS}, CASE WHEN count(*) >= 3 AND sum(trials) >= 10 AND NOT bool_and(fit >= 0.9::DOUBLE) AND NOT bool_and(fit < 0.9::DOUBLE) THEN arg_min(CASE WHEN fit = 0.9::DOUBLE THEN CAST(depth AS DOUBLE)
    ELSE depth + (fit - 0.9::DOUBLE) / (fit - q) * (e - depth) END, depth) FILTER (fit >= 0.9::DOUBLE AND q < 0.9::DOUBLE) END AS horizon FROM l GROUP BY ALL),
f AS (SELECT rep, subject, 'family_delta:' || family_id AS scalar, max(horizon) FILTER (snapshot_id = 'current') - max(horizon) FILTER (snapshot_id = 'base') AS value FROM h GROUP BY ALL),
j AS (SELECT rep, subject, o.base_horizon AS ob, o.current_horizon AS oc, o.delta AS od, r.base_horizon AS rb, r.current_horizon AS rc, r.delta AS rd FROM o FULL JOIN r USING (rep, subject)),
x AS (SELECT rep, subject, unnest([{{'scalar': 'observed_base_horizon', 'value': ob}}, {{'scalar': 'observed_current_horizon', 'value': oc}}, {{'scalar': 'observed_mix_delta', 'value': od}}, {{'scalar': 'reference_base_horizon', 'value': rb}},
  {{'scalar': 'reference_current_horizon', 'value': rc}}, {{'scalar': 'composition_adjusted_delta', 'value': rd}}, {{'scalar': 'composition_residual', 'value': od - rd}}], recursive := true) FROM j),
vals_v AS (SELECT subject, scalar, coalesce(list_sort(list(value) FILTER (value IS NOT NULL)), []) AS v FROM (FROM x UNION ALL FROM f) WHERE rep >= 0 GROUP BY ALL),
okv AS (SELECT *, len(v) > 0 AND len(v) / {REPLICATES}.0::DOUBLE >= {MIN_FRACTION} AS ok FROM vals_v) SELECT subject, scalar, {_band_cols()} FROM okv""",
    "simplex_grid": f"WITH {_GRID} SELECT cell, a || ',' || n || ',' || r AS units FROM grid_v",
    "mixture_scan": f"WITH {SQL_TRIALS}, {_POINT}, {_FIT}, {_GRIDW}, {_MIX} SELECT obs, cell, subject, {_r('base_horizon')} AS base_horizon, {_r('current_horizon')} AS current_horizon, reasons, {_r('delta')} AS delta FROM delta_v",
    "sensitivity_range": f"""WITH {SQL_TRIALS}, {_POINT}, {_FIT}, {_GRIDW}, {_MIX}, k AS (SELECT *, row_number() OVER (PARTITION BY obs, subject ORDER BY delta, cell) AS lo, row_number() OVER (PARTITION BY obs, subject ORDER BY delta DESC, cell) AS hi FROM delta_v WHERE delta IS NOT NULL)
SELECT obs, subject, count(*) AS n_supported, {_r('min(delta)')} AS least, max(cell) FILTER (lo = 1) AS least_cell, {_r('max(delta)')} AS greatest, max(cell) FILTER (hi = 1) AS greatest_cell, {_r('max(delta) - min(delta)')} AS span FROM k GROUP BY obs, subject""",
    "joint_surface": f"WITH {_SURFACE} SELECT * EXCLUDE (a, n, r, supported_replicates) FROM surface_v",
    "surface_summary": f"""WITH {_SURFACE} SELECT obs, subject, count(*) AS n_cells, count(*) FILTER (supported) AS n_supported, count(*) FILTER (sign_class = 'positive_band') AS n_positive_band, count(*) FILTER (sign_class = 'negative_band') AS n_negative_band,
  count(*) FILTER (sign_class = 'zero_band') AS n_zero_band, count(*) FILTER (sign_class = 'crosses_zero') AS n_crosses_zero, {_r('min(upper - lower)')} AS min_width, {_r('max(upper - lower)')} AS max_width FROM surface_v GROUP BY ALL""",
    "evidence_checks": f"""WITH {SQL_TRIALS} SELECT {_KEYS}, depth, 'trials_not_positive' AS rule FROM trials_v WHERE depth % 5 = 0
  UNION ALL SELECT {_KEYS}, depth, 'successes_out_of_range' FROM trials_v WHERE depth % 4 = 0 OR (depth % 5 = 0 AND successes > 0)""",
    "class_turnover": f"""WITH {_SURFACE} SELECT step, subject, class, count(*) FILTER (NOT was AND now AND to_class = class) AS gained, count(*) FILTER (was AND NOT now AND from_class = class) AS lost,
  count(*) FILTER (was AND now AND from_class = class AND to_class = class) AS kept, count(*) FILTER (was AND now AND from_class = class AND to_class <> class) AS left
  FROM step_v, (VALUES ('positive_band'), ('negative_band'), ('crosses_zero'), ('zero_band')) k(class) GROUP BY ALL""",
    "surface_isolated": f"""WITH {_SURFACE} SELECT obs, subject, cell FROM surface_v s WHERE supported AND NOT EXISTS (FROM edge_v e WHERE e.obs = s.obs AND e.subject = s.subject AND (e.cell_a = s.cell OR e.cell_b = s.cell) AND sa AND sb)""",
    "surface_edges": f"WITH {_SURFACE} SELECT obs, subject, cell_a, cell_b FROM edge_v",
    "surface_components": f"WITH RECURSIVE {_SURFACE}, {_comp(False)} SELECT * FROM comp_v",
    "sign_regions": f"WITH RECURSIVE {_SURFACE}, {_comp(True)} SELECT * FROM comp_v",
    "support_boundary": f"WITH {_SURFACE} SELECT obs, subject, cell_a, cell_b, sa AS supported_a FROM edge_v WHERE sa <> sb",
    "sign_boundary": f"WITH {_SURFACE} SELECT obs, subject, cell_a, cell_b, ca AS sign_class_a, cb AS sign_class_b FROM edge_v WHERE sa AND sb AND ca <> cb",
    "surface_gradients": f"WITH {_SURFACE} SELECT obs, subject, cell_a, cell_b, {_r('delta_slope')} AS delta_slope, {_r('lower_slope')} AS lower_slope, {_r('upper_slope')} AS upper_slope FROM grad_v",
    "surface_crossings": f"WITH {_SURFACE} SELECT obs, subject, field, cell_a, cell_b, {_r('least(1, greatest(0, fraction))')} AS fraction FROM crossing_v",
    "domain_motion": f"""WITH {_SURFACE}, m AS (SELECT step, subject, count(*) FILTER (was AND now) AS persistent, count(*) FILTER (NOT was AND now) AS gained, count(*) FILTER (was AND NOT now) AS lost FROM step_v GROUP BY ALL)
SELECT *, {_r('CASE WHEN persistent + gained + lost = 0 THEN 1.0::DOUBLE ELSE persistent / CAST(persistent + gained + lost AS DOUBLE) END')} AS jaccard FROM m""",
    "sign_migration": f"WITH {_SURFACE} SELECT step, subject, from_class, to_class, count(*) AS n FROM step_v WHERE was AND now GROUP BY ALL",
    "component_motion": f"""WITH RECURSIVE {_SURFACE}, {_comp(False)}, l AS (SELECT x.obs AS step, x.subject, x.component, y.component AS next_component, count(*) AS shared FROM comp_v x JOIN comp_v y ON y.obs = x.obs + 1 AND y.subject = x.subject AND y.cell = x.cell GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY step, subject, component) > 1 AS splits, count(*) OVER (PARTITION BY step, subject, next_component) > 1 AS merges FROM l""",
    "gradient_drift": f"""WITH {_SURFACE}, x AS (SELECT * FROM grad_v WHERE obs < {len(TARGETS) - 1}), y AS (SELECT obs - 1 AS obs, subject, cell_a, cell_b, delta_slope AS s2 FROM grad_v WHERE obs > 0)
SELECT obs AS step, subject, cell_a, cell_b, CASE WHEN delta_slope IS NOT NULL AND s2 IS NOT NULL THEN 'matched' WHEN s2 IS NOT NULL THEN 'appeared' ELSE 'disappeared' END AS status, {_r('s2 - delta_slope')} AS slope_change
FROM x FULL JOIN y USING (obs, subject, cell_a, cell_b)""",
    "support_trajectory": f"""WITH {_SURFACE}, n AS (SELECT subject, obs, count(*) FILTER (supported) AS n FROM surface_v GROUP BY ALL), d AS (SELECT *, n - lag(n) OVER (PARTITION BY subject ORDER BY obs) AS change FROM n),
z AS (SELECT subject, obs, sign(change) AS s FROM d WHERE change <> 0), f AS (SELECT subject, count(*) FILTER (s <> p) AS reversals FROM (SELECT *, lag(s) OVER (PARTITION BY subject ORDER BY obs) AS p FROM z) GROUP BY subject)
SELECT subject, string_agg(CAST(n AS VARCHAR), ',' ORDER BY obs) AS counts, min(n) AS least, max(n) AS most, count(*) FILTER (change > 0) AS expansions, count(*) FILTER (change < 0) AS contractions, count(*) FILTER (change = 0) AS flat_steps,
  coalesce(any_value(reversals), 0) AS reversals FROM d LEFT JOIN f USING (subject) GROUP BY subject""",
    "sign_persistence": f"""WITH {_SURFACE}, k AS (SELECT DISTINCT subject, cell FROM surface_v WHERE supported), s AS (SELECT k.subject, k.cell, o.obs, coalesce(CASE WHEN x.supported THEN x.sign_class END, 'unsupported') AS c FROM k CROSS JOIN (SELECT DISTINCT obs FROM surface_v) o
  LEFT JOIN surface_v x ON x.subject = k.subject AND x.cell = k.cell AND x.obs = o.obs), g AS (SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS q, obs - row_number() OVER (PARTITION BY subject, cell, c = 'positive_band' ORDER BY obs) AS run FROM s WINDOW w AS (PARTITION BY subject, cell ORDER BY obs)),
m AS (SELECT subject, cell, max(n) AS longest FROM (SELECT subject, cell, run, count(*) AS n FROM g WHERE c = 'positive_band' GROUP BY ALL) GROUP BY ALL)
SELECT subject, cell, string_agg(c, ',' ORDER BY obs) AS statuses, count(*) FILTER (c <> 'unsupported') AS n_supported, count(*) FILTER (c <> p) AS n_changes,
  coalesce(bool_or(p IS NOT NULL AND q IS NOT NULL AND (p = 'unsupported') = (q = 'unsupported') AND (c = 'unsupported') <> (p = 'unsupported')), false) AS support_excursion, coalesce(any_value(longest), 0) AS longest_positive_run
FROM g LEFT JOIN m USING (subject, cell) GROUP BY subject, cell""",
    "gradient_trajectory": f"""WITH {_SURFACE}, d AS (SELECT *, CASE WHEN lag(obs) OVER w = obs - 1 THEN delta_slope - lag(delta_slope) OVER w END AS change FROM grad_v WINDOW w AS (PARTITION BY subject, cell_a, cell_b ORDER BY obs)),
z AS (SELECT subject, cell_a, cell_b, obs, CASE WHEN change > 0 THEN 1 ELSE -1 END AS s FROM d WHERE abs(change) > 1e-12), f AS (SELECT subject, cell_a, cell_b, count(*) FILTER (s <> p) AS reversals FROM (SELECT *, lag(s) OVER (PARTITION BY subject, cell_a, cell_b ORDER BY obs) AS p FROM z) GROUP BY ALL)
SELECT subject, cell_a, cell_b, count(*) AS n_present, count(*) = {len(TARGETS)} AS persistent, {_r('max(abs(change))')} AS max_abs_change, coalesce(any_value(reversals), 0) AS reversals FROM d LEFT JOIN f USING (subject, cell_a, cell_b) GROUP BY ALL""",
    "reason_counts": f"""WITH {SQL_TRIALS}, {_ALL}, {_GRIDW}, {_MIX}, e AS (SELECT obs, subject, unnest(string_split(reasons, ';')) AS reason FROM delta_v WHERE rep >= 0 AND reasons <> '')
SELECT obs, subject, reason, count(*) AS n FROM e GROUP BY ALL""",
    "frontier_motion": f"""WITH {_SURFACE}, e AS (SELECT obs, subject, cell_a, cell_b FROM edge_v WHERE sa <> sb), x AS (SELECT *, 1 AS p FROM e WHERE obs < {len(TARGETS) - 1}),
y AS (SELECT obs - 1 AS obs, subject, cell_a, cell_b, 1 AS q FROM e WHERE obs > 0)
SELECT obs AS step, subject, count(*) FILTER (p = 1 AND q = 1) AS persistent, count(*) FILTER (p IS NULL) AS gained, count(*) FILTER (q IS NULL) AS lost FROM x FULL JOIN y USING (obs, subject, cell_a, cell_b) GROUP BY ALL""",
    "component_lineage": f"""WITH RECURSIVE {_SURFACE}, {_comp(False)}, k AS (SELECT DISTINCT subject, obs, component, lpad(CAST(obs AS VARCHAR), 4, '0') || '@' || lpad(CAST(component AS VARCHAR), 4, '0') AS node FROM comp_v),
l AS (SELECT DISTINCT x.subject, a.node AS a, b.node AS b FROM comp_v x JOIN comp_v y ON y.obs = x.obs + 1 AND y.subject = x.subject AND y.cell = x.cell
  JOIN k a ON a.subject = x.subject AND a.obs = x.obs AND a.component = x.component JOIN k b ON b.subject = y.subject AND b.obs = y.obs AND b.component = y.component),
r AS (SELECT subject, node AS a, node AS b FROM k UNION SELECT r.subject, r.a, t.b FROM r JOIN (SELECT subject, a, b FROM l UNION ALL SELECT subject, b, a FROM l) t ON t.subject = r.subject AND t.a = r.b),
g AS (SELECT subject, a AS node, min(b) AS lineage FROM r GROUP BY ALL),
o AS (SELECT subject, a AS node, count(*) > 1 AS f FROM l GROUP BY ALL), i AS (SELECT subject, b AS node, count(*) > 1 AS f FROM l GROUP BY ALL)
SELECT g.subject, lineage, count(*) AS n_nodes, min(CAST(g.node[1:4] AS BIGINT)) AS first_obs, max(CAST(g.node[1:4] AS BIGINT)) AS last_obs, count(*) FILTER (o.f) AS n_splits, count(*) FILTER (i.f) AS n_merges
FROM g LEFT JOIN o ON o.subject = g.subject AND o.node = g.node LEFT JOIN i ON i.subject = g.subject AND i.node = g.node GROUP BY ALL""",
}
ORACLE["axis_comparison"] = f"""WITH b AS ({ORACLE['bootstrap_bands']}), s AS ({ORACLE['sensitivity_range']}), j AS (SELECT b.obs, b.subject, span, upper - lower AS width FROM b LEFT JOIN s ON s.obs = b.obs AND s.subject = b.subject)
SELECT obs, subject, {_r('span')} AS span, {_r('width')} AS width, {_r('CASE WHEN width <> 0 THEN span / width END')} AS ratio, CASE WHEN span IS NULL OR width IS NULL THEN 'unavailable' WHEN abs(span - width) <= 1e-9 THEN 'equal'
  WHEN span > width THEN 'mixture_choice' ELSE 'sampling' END AS larger_axis FROM j"""
