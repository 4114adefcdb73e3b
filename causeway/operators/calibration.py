"""Reliability horizons: Wilson intervals, isotonic curves, crossings, mixtures, bootstrap and grid surfaces.

Everything is one long table of evidence points (keys, family_id, subject, depth, trials, successes). A bootstrap
replicate is one more key (-1 is the point estimate), an observation's target and a grid cell are further keys, so each
layer is the same plan over more rows: no driver loop, one shuffle by curve and one by mixture. Curves are arrays in
their rows, bounded by the number of distinct depths.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import lerp_quantile, sign_of, uniform_bar, wilson
from ..functions.lineage import cut
from .validation import check

TOLERANCE = 1e-12


def points(evidence: DataFrame, *keys: str) -> DataFrame:
    """Trials and successes added up by depth; rows with no trials, or more successes than trials, are left out."""
    sound = evidence.where("trials > 0 and successes between 0 and trials and depth is not null")
    return sound.groupBy(*keys, "depth").agg(F.sum("trials").alias("trials"), F.sum("successes").alias("successes"))


def evidence_violations(evidence: DataFrame, *keys: str) -> DataFrame:
    """(keys, depth, rule) of the rows that ``points`` leaves out: no depth, no trials, or successes that are not among the trials."""
    rules = [
        ("depth_missing", F.col("depth").isNull()),
        ("trials_not_positive", ~F.coalesce(F.col("trials") > 0, F.lit(False))),
        ("successes_out_of_range", ~F.coalesce(F.col("successes").between(F.lit(0), F.col("trials")), F.lit(False))),
    ]
    return check(evidence.withColumn("row", F.struct(*keys, "depth")), "row", rules).select("row.*", "rule")


def intervals(pts: DataFrame, confidence: float) -> DataFrame:
    low, high = wilson(F.col("successes"), F.col("trials"), confidence)
    rate = F.col("successes").cast("double") / F.col("trials").cast("double")
    return pts.withColumns({"rate": rate, "wilson_lower": low, "wilson_upper": high})


#: Isotonic (non-increasing) fit by the min-max formula on prefix sums ct and cs: for point i the least over starts
#: a <= i of the greatest pooled rate over ends b >= i.
_FIT = """
transform(sequence(1, size(p)), i -> struct(p[i - 1].depth as depth, p[i - 1].trials as trials, p[i - 1].successes as successes,
  array_min(transform(sequence(1, i), a -> array_max(transform(sequence(i, size(p)), b ->
    double(cs[b] - cs[a - 1]) / double(ct[b] - ct[a - 1]))))) as fit))
"""
_PREFIX = "aggregate(p, array(bigint(0)), (acc, x) -> array_append(acc, element_at(acc, -1) + x.{}))"


def curves(pts: DataFrame, *keys: str) -> DataFrame:
    """One row for each curve: pts, an array of (depth, trials, successes, fit) by depth."""
    gathered = pts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("depth").cast("double").alias("depth"), "trials", "successes"))).alias("p")
    )
    return gathered.withColumns({"ct": F.expr(_PREFIX.format("trials")), "cs": F.expr(_PREFIX.format("successes"))}).select(
        *keys, F.expr(_FIT).alias("pts")
    )


def _crossing(name: str, value: str) -> tuple[Column, Column]:
    """(status, horizon) of the array ``name`` of (depth, value) against the column target."""
    e = F.expr(f"""
      case when forall({name}, x -> x.{value} >= target) then struct('target_not_bracketed_high' as status, cast(null as double) as horizon)
           when forall({name}, x -> x.{value} < target) then struct('target_not_bracketed_low' as status, cast(null as double) as horizon)
           else element_at(concat(filter(transform(sequence(1, size({name}) - 1), i -> case
             when {name}[i - 1].{value} >= target and {name}[i].{value} < target then struct('supported' as status,
               case when {name}[i - 1].{value} = target then {name}[i - 1].depth
                    else {name}[i - 1].depth + ({name}[i - 1].{value} - target) / ({name}[i - 1].{value} - {name}[i].{value})
                         * ({name}[i].depth - {name}[i - 1].depth) end as horizon) end), x -> x is not null),
             array(struct('target_not_bracketed_in_common_support' as status, cast(null as double) as horizon))), 1) end""")
    return e["status"], e["horizon"]


def horizons(found: DataFrame, min_depths: int = 3, min_trials: int = 10, min_per_depth: int = 1) -> DataFrame:
    """status and horizon of each curve at its target; too little evidence comes first."""
    status, horizon = _crossing("pts", "fit")
    reasons = F.concat_ws(
        ",",
        F.when(F.size("pts") < min_depths, "insufficient_distinct_depths"),
        F.when(F.expr("aggregate(pts, bigint(0), (a, x) -> a + x.trials)") < min_trials, "insufficient_total_trials"),
        F.when(F.expr("array_min(transform(pts, x -> x.trials))") < min_per_depth, "insufficient_trials_per_depth"),
    )
    thin = reasons != ""
    return found.withColumns(
        {
            "status": F.when(thin, "insufficient_evidence").otherwise(status),
            "evidence_reasons": reasons,
            "horizon": F.when(~thin, horizon),
        }
    )


def assessment(found: DataFrame, *keys: str) -> DataFrame:
    """Autonomy and governance horizon side by side; gap = autonomy less governance."""
    def of(subject: str) -> Column:
        return F.max(F.when(F.col("subject") == subject, F.col("horizon")))

    both = found.groupBy(*keys).agg(of("autonomy").alias("h_autonomy"), of("governance").alias("h_governance"))
    gap = F.col("h_autonomy") - F.col("h_governance")
    return both.withColumns({"gap": gap, "margin": -gap})


def observed_weights(pts: DataFrame, *keys: str) -> DataFrame:
    """Each family's share of the trials of its (keys, subject)."""
    from pyspark.sql.window import Window

    mass = pts.groupBy(*keys, "subject", "family_id").agg(F.sum("trials").alias("mass"))
    total = F.sum("mass").over(Window.partitionBy(*keys, "subject"))
    return mass.withColumn("weight", F.col("mass").cast("double") / total.cast("double"))


#: For each depth that any family has: the families' rates there, on the line between the points around it (null outside of
#: a family's points), and which of them have a point there.
_RATES = """
transform(array_sort(array_distinct(flatten(transform(fams, f -> transform(f.pts, x -> x.depth))))), d -> struct(d as depth,
  transform(fams, f -> transform(array(struct(try_element_at(filter(f.pts, x -> x.depth <= d), -1) as l, try_element_at(filter(f.pts, x -> x.depth >= d), 1) as h)),
    e -> case when e.l.depth = e.h.depth then e.l.fit else e.l.fit + (d - e.l.depth) / (e.h.depth - e.l.depth) * (e.h.fit - e.l.fit) end)[0]) as rates,
  transform(fams, f -> exists(f.pts, x -> x.depth = d)) as own))
"""
#: The weighted rate at every depth of a family that takes part, where all that do reach.
_MIXED = """
transform(filter(rates, r -> r.depth between low and high and exists(zip_with(r.own, w, (o, y) -> o and y > 0), x -> x)),
  r -> struct(r.depth as depth, aggregate(zip_with(r.rates, w, (x, y) -> case when y > 0 then y * x else 0D end), 0D, (acc, v) -> acc + v) as p))
"""


def mixtures(found: DataFrame, weights: DataFrame, targets: DataFrame, *keys: str) -> DataFrame:
    """status and horizon of each mixture of family curves.

    found: one row for each (keys, subject, family_id) with pts. weights: (cell, weights map of family to weight), a
    grid whose size simplex_grid bounds. targets: (obs, target). Families of weight 0 take no part. Weighted sums run in
    the order of the families. A column ``weights`` in found (observed shares) is used where weights is None. Rates are
    interpolated once for each key, the curve is mixed once for each cell, and only crossings are looked for at each target.
    """
    own = ["weights"] if weights is None else []
    mixed = found.groupBy(*keys, "subject", *own).agg(F.array_sort(F.collect_list(F.struct("family_id", "pts"))).alias("fams"))
    mixed = mixed.withColumn("rates", F.expr(_RATES))
    if weights is not None:
        mixed = mixed.join(F.broadcast(weights))
    mixed = mixed.withColumn("w", F.expr("transform(fams, f -> coalesce(weights[f.family_id], 0D))"))
    mixed = mixed.withColumn("fams", F.expr("filter(fams, f -> weights[f.family_id] > 0)"))
    mixed = mixed.withColumns(
        {
            "low": F.expr("array_max(transform(fams, f -> f.pts[0].depth))"),
            "high": F.expr("array_min(transform(fams, f -> element_at(f.pts, -1).depth))"),
            # all that a target has to know of a family to refuse it
            "ends": F.expr("transform(fams, f -> struct(f.family_id, array_min(transform(f.pts, x -> x.fit)) as least, array_max(transform(f.pts, x -> x.fit)) as most))"),
        }
    )
    kept = [*keys, "subject", *([] if weights is None else ["cell"]), "low", "high", "ends"]
    mixed = mixed.select(*kept, F.when(F.col("low") < F.col("high"), F.expr(_MIXED)).alias("mixed")).join(F.broadcast(targets))
    refused = F.filter("ends", lambda f: (f["least"] >= F.col("target")) | (f["most"] < F.col("target")))
    mixed = mixed.withColumn("refused", F.array_join(F.transform(refused, lambda f: F.concat(F.lit("family_unsupported:"), f["family_id"])), ","))
    mixed = mixed.withColumn("curve", F.when(F.col("refused") == "", F.col("mixed")))
    status, horizon = _crossing("curve", "p")
    return mixed.select(
        *keys,
        "subject",
        "obs",
        *([] if weights is None else ["cell"]),
        F.when(F.col("refused") != "", F.col("refused"))
        .when(F.col("low") >= F.col("high"), "no_common_depth_support")
        .otherwise(status)
        .alias("status"),
        F.when(F.col("curve").isNotNull(), horizon).alias("horizon"),
        "curve",
    )


#: Draws of one row of a resample's plan.
DRAWS = 1 << 14


def by_replicate(df: DataFrame) -> DataFrame:
    """df dealt by rep to as many tasks as the session runs. All that follows is keyed by rep, so nothing is shuffled again; the rows
    are few, so Spark would bring them together in one task, but each stands for much work."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, "rep")


def resample(pts: DataFrame, seed: str, replicates: int) -> DataFrame:
    """Binomial resamples of every point by keyed uniforms: rep, the point's keys, trials and new successes.

    A uniform depends on its labels alone, so any partitioning, retry or order gives the same counts. Points that never
    or always succeed need no draws.
    """
    keys = ["snapshot_id", "family_id", "subject", "depth"]
    spark = pts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # points do not grow with the data and are read three times: written once, with a number that is cheaper to group draws by
    numbered = cut(pts.select(F.monotonically_increasing_id().alias("point"), *keys, "trials", "successes"))
    reps = numbered.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    fixed = reps.where("successes = 0 or successes = trials").select("rep", *keys, "trials", "successes")
    labels = F.concat_ws("\x1f", F.lit(seed), *[F.col(c).cast("string") for c in ("snapshot_id", "rep", "family_id", "subject", "depth")])
    rate = F.col("successes").cast("double") / F.col("trials").cast("double")
    # draws do grow: replicates and runs of draws are dealt out before any is made
    dealt = (
        reps.where("successes > 0 and successes < trials")
        .withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trials") - 1, F.lit(DRAWS).cast("long"))))
        .select("rep", "point", "start", F.least(F.col("start") + DRAWS, F.col("trials")).alias("end"), labels.alias("labels"), uniform_bar(rate).alias("bar"))
        .repartition(4 * tasks, "rep", "point", "start")
    )
    below = F.sha2(F.concat("labels", F.lit("\x1f"), F.col("attempt").cast("string")), 256) < F.col("bar")
    drawn = (
        dealt.select("rep", "point", "labels", "bar", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("attempt"))
        .groupBy("rep", "point")
        .agg(F.count_if(below).alias("successes"))
        .join(F.broadcast(numbered.drop("successes")), "point")
        .select("rep", *keys, "trials", "successes")
    )
    return fixed.union(drawn)


def grid_units(step: float, least: float, n_families: int) -> tuple[int, int]:
    """(units, least units of a family) of a grid of that step; raises where they do not divide one, or leave no grid."""
    if not (0 < step < 1 and 0 < least < 1):
        raise ValueError("the step and the least weight must lie strictly between 0 and 1")
    units, low = round(1 / step), round(least * round(1 / step))
    if units < 2 or abs(1 / step - units) > 1e-9:
        raise ValueError("the step must divide one")
    if low < 1 or abs(least * units - low) > 1e-9:
        raise ValueError("the least weight must be a multiple of the step")
    if low * n_families > units:
        raise ValueError("the least weight leaves no grid")
    return units, low


def normalized_weights(weights: dict[str, float], families: Sequence[str]) -> dict[str, float]:
    """Weights of exactly these families, divided by their sum; raises unless all are positive and finite."""
    if set(weights) != set(families) or not families:
        raise ValueError("weights must name exactly the families that are compared")
    if not all(math.isfinite(w) and w > 0 for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    total = sum(weights[f] for f in sorted(families))
    return {f: weights[f] / total for f in sorted(families)}


def simplex_grid(spark, families: Sequence[str], units: int = 10, least: int = 1, max_cells: int = 20_000) -> DataFrame:
    """cell, units (array) and weights (map) of all compositions of ``units`` into the families, in lexicographic order.

    A grid of more than ``max_cells`` is an error: grids are broadcast. Units too few for the families give no cell.
    """
    free = units - least * len(families)
    cells = math.comb(free + len(families) - 1, len(families) - 1) if families and free >= 0 else 0
    if cells > max_cells:
        raise ValueError(f"a grid of {units} units over {len(families)} families has {cells} cells, more than {max_cells}")
    out = spark.range(1).select(F.array().cast("array<int>").alias("units"), F.lit(units).alias("left"))
    for i in range(len(families)):
        rest = least * (len(families) - i - 1)
        last = i == len(families) - 1
        choice = F.array("left") if last else F.sequence(F.lit(least), F.col("left") - rest)
        out = out.where(F.col("left") >= least + rest).withColumn("u", F.explode(choice)).select(
            F.array_append("units", F.col("u").cast("int")).alias("units"), (F.col("left") - F.col("u")).alias("left")
        )
    shares = F.transform("units", lambda u: u.cast("double") / F.lit(float(units)))
    return out.select(
        F.array_join(F.transform("units", lambda u: F.lpad(u.cast("string"), 2, "0")), "-").alias("cell"),
        "units",
        F.map_from_arrays(F.array(*map(F.lit, families)), shares).alias("weights"),
    )


def deltas(mixed: DataFrame, *keys: str) -> DataFrame:
    """current less base horizon; null unless both are supported. reasons: the statuses that stand against it."""
    def of(snapshot: str, column: str) -> Column:
        return F.max(F.when(F.col("snapshot_id") == snapshot, F.col(column)))

    both = mixed.groupBy(*keys).agg(
        of("base", "horizon").alias("base_horizon"),
        of("current", "horizon").alias("current_horizon"),
        F.array_join(
            F.array_sort(
                F.collect_set(F.when(F.col("status") != "supported", F.concat("snapshot_id", F.lit(":"), "status")))
            ),
            ";",
        ).alias("reasons"),
    )
    return both.withColumn("delta", F.col("current_horizon") - F.col("base_horizon"))


def family_deltas(found: DataFrame) -> DataFrame:
    """Change of each family and subject; a family that a snapshot lacks has the status missing_family there."""
    def of(snapshot: str, column: str) -> Column:
        return F.max(F.when(F.col("snapshot_id") == snapshot, F.col(column)))

    names = ("base", "current")
    both = found.groupBy("family_id", "subject").agg(
        *[of(x, "horizon").alias(f"{x}_horizon") for x in names],
        *[F.coalesce(of(x, "status"), F.lit("missing_family")).alias(f"{x}_status") for x in names],
    )
    against = [F.when(F.col(f"{x}_status") != "supported", F.concat(F.lit(f"{x}:"), f"{x}_status")) for x in names]
    delta = F.col("current_horizon") - F.col("base_horizon")
    return both.withColumns({"reasons": F.concat_ws(";", *against), "delta": delta, "direction": sign_of(delta, TOLERANCE).cast("int")})


def agreement(families: DataFrame, adjusted: DataFrame, elapsed: DataFrame) -> DataFrame:
    """How the families of each subject go along with its adjusted change.

    families: of family_deltas; adjusted: (subject, adjusted_delta); elapsed: one row with elapsed_days between the
    snapshots. The share of agreeing families is null where the adjusted change or all theirs are; the change a day where no time went by.
    """
    def ends(x: str) -> list[Column]:
        return [F.min(f"{x}_horizon").alias(f"{x}_least"), F.max(f"{x}_horizon").alias(f"{x}_greatest")]

    agrees = F.col("direction") == sign_of(F.col("adjusted_delta"), TOLERANCE)
    found = families.join(adjusted.select("subject", "adjusted_delta"), "subject", "left").groupBy("subject").agg(
        F.max("adjusted_delta").alias("adjusted_delta"),
        (F.count("delta") / F.count(F.lit(1))).alias("supported_fraction"),
        F.avg(agrees.cast("double")).alias("direction_agreement"),
        *ends("base"),
        *ends("current"),
        F.max(F.abs("delta")).alias("max_abs_delta"),
    )
    per_day = F.when(F.col("elapsed_days") > 0, F.col("adjusted_delta") / F.col("elapsed_days"))
    return found.join(elapsed.select("elapsed_days")).withColumn("per_day", per_day)


def context(snapshots: DataFrame) -> DataFrame:
    """What differs between the snapshots base and current, the kind of comparison that this is, and the days between them.

    snapshots: (snapshot_id, observed_at, backend_id, benchmark_version, agent_config_id, families), a row for each of the two.
    violation: current_precedes_base, or missing_snapshot; else null. Null contexts are equal to each other.
    """
    def of(snapshot: str, column: str) -> Column:
        return F.max(F.when(F.col("snapshot_id") == snapshot, F.col(column)))

    axes = {"backend_id": "backend_changed", "benchmark_version": "benchmark_version_changed", "agent_config_id": "agent_config_changed", "families": "family_set_changed"}
    ordered = snapshots.withColumn("families", F.array_sort(F.array_distinct("families")))
    both = ordered.agg(
        *[(~of("base", k).eqNullSafe(of("current", k))).alias(name) for k, name in axes.items()],
        ((F.unix_micros(of("current", "observed_at")) - F.unix_micros(of("base", "observed_at"))) / 86_400_000_000).alias("elapsed_days"),
    )
    changed = sum((F.col(name).cast("int") for name in axes.values()), F.lit(0))
    kind = F.when(F.col("backend_changed") & (changed == 1), "cross_backend").when(changed == 0, "longitudinal_same_configuration")
    violation = F.when(F.col("elapsed_days").isNull(), "missing_snapshot").when(F.col("elapsed_days") < 0, "current_precedes_base")
    return both.withColumns({"comparison_kind": kind.otherwise("mixed_configuration_change"), "violation": violation})


def bands(values: DataFrame, value: str, keys: Sequence[str], replicates: int, interval: float, min_fraction: float) -> DataFrame:
    """Quantile band, mean, support and sign shares of the non-null values of each key."""
    tail = (1 - interval) / 2
    got = values.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("v"))
    fraction = F.size("v") / F.lit(float(replicates))
    ok = (F.size("v") > 0) & (fraction >= min_fraction)

    def share(sign: int) -> Column:
        hits = F.size(F.filter("v", lambda x: sign_of(x, TOLERANCE) == sign))
        return F.when(F.size("v") > 0, hits / F.size("v"))

    return got.select(
        *keys,
        F.size("v").cast("long").alias("supported_replicates"),
        fraction.alias("supported_fraction"),
        ok.alias("supported"),
        F.when(ok, lerp_quantile(F.col("v"), tail)).alias("lower"),
        F.when(ok, lerp_quantile(F.col("v"), 0.5)).alias("median"),
        F.when(ok, lerp_quantile(F.col("v"), 1 - tail)).alias("upper"),
        F.when(ok, F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("mean"),
        share(1).alias("positive_share"),
        share(-1).alias("negative_share"),
        share(0).alias("zero_share"),
    )


def comparison_scalars(observed: DataFrame, reference: DataFrame, families: DataFrame, *keys: str) -> DataFrame:
    """(keys, subject, scalar, value): all numbers that a comparison of two snapshots gives, for each value of the keys, such as replicates.

    observed and reference: (keys, subject, snapshot_id, status, horizon) of the mixtures under each snapshot's own weights and the
    reference weights; families: the same with family_id, for each family alone. A value that is not supported is null.
    """

    def sides(mixed: DataFrame, *more: str) -> DataFrame:
        return deltas(mixed, *keys, "subject", *more).drop("reasons")

    own, ref = sides(observed), sides(reference).toDF(*keys, "subject", "r_base", "r_current", "adjusted")
    both = own.join(ref, [*keys, "subject"], "full_outer")
    named = {
        "observed_base_horizon": F.col("base_horizon"),
        "observed_current_horizon": F.col("current_horizon"),
        "observed_mix_delta": F.col("delta"),
        "reference_base_horizon": F.col("r_base"),
        "reference_current_horizon": F.col("r_current"),
        "composition_adjusted_delta": F.col("adjusted"),
        "composition_residual": F.col("delta") - F.col("adjusted"),
    }
    each = F.explode(F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*named.values()))).alias("scalar", "value")
    family = sides(families, "family_id").select(*keys, "subject", F.concat(F.lit("family_delta:"), "family_id").alias("scalar"), F.col("delta").alias("value"))
    return both.select(*keys, "subject", each).union(family)


def sign_class(lower: Column, upper: Column, supported: Column) -> Column:
    return (
        F.when(~supported, "unsupported")
        .when(lower > TOLERANCE, "positive_band")
        .when(upper < -TOLERANCE, "negative_band")
        .when((F.abs(lower) <= TOLERANCE) & (F.abs(upper) <= TOLERANCE), "zero_band")
        .otherwise("crosses_zero")
    )
