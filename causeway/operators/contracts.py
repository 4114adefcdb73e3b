"""Contracts between the layers of reports, as violation rows: versions, measurement contracts, surfaces, trajectories.

Each function returns what is wrong instead of stopping at it; a report, surface or trajectory without rows is sound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .validation import OFFSET_TIME, check

# The version that each kind of report must name, and the names that surfaces use.
VERSIONS = {
    "integrity": "0.2.2",
    "approval": "0.2.3",
    "metrics": "0.2.5",
    "signals": "0.2.6",
    "assessment": "0.2.6",
    "calibration": "0.2.7",
    "snapshot": "0.2.8",
    "bootstrap": "0.2.9",
    "mixture_scan": "0.2.10",
    "joint_surface": "0.2.11",
    "geometry": "0.2.12",
    "drift": "0.2.13",
    "trajectory": "0.2.14",
}
SURFACE_METHOD = "joint_empirical_binomial_simplex_surface_v1"
SIGN_CLASSES = ("positive_band", "negative_band", "crosses_zero", "zero_band", "unsupported")
SUBJECTS = ("autonomy", "governance")
UNIT = "interaction_depth"
CONTRACT = ("unit", "reliability_p", "scope_id", "assessment_method")


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def gate(reports: DataFrame, versions: dict[str, str] = VERSIONS) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of reports (report_id, kind, body as JSON text).

    accepted: report_id, kind and body as VARIANT, for reports whose kind is known and whose schema_version is the kind's.
    refused: report_id, rule and found, the version that was named.
    """
    known = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])
    rows = reports.withColumns({"payload": F.try_parse_json("body"), "wanted": F.element_at(known, F.col("kind"))})
    is_object = F.schema_of_variant("payload").startswith("OBJECT")
    # a version that is no text is no version
    text = F.schema_of_variant(F.try_variant_get("payload", "$.schema_version", "variant")) == "STRING"
    rows = rows.withColumn("found", F.when(is_object & text, F.try_variant_get("payload", "$.schema_version", "string")))
    rule = (
        F.when(F.col("payload").isNull(), "malformed_json")
        .when(~is_object, "not_an_object")
        .when(F.col("wanted").isNull(), "unknown_kind")
        .when(F.col("found").isNull(), "schema_version_missing")
        .when(F.col("found") != F.col("wanted"), "schema_version_unsupported")
    )
    rows = rows.withColumn("rule", rule)
    accepted = rows.where("rule is null").select("report_id", "kind", F.col("payload").alias("body"))
    return accepted, rows.where("rule is not null").select("report_id", "rule", "found")


def _time_rules(name: str) -> list[tuple[str, Column]]:
    return [
        (f"{name}_missing", _blank(name)),
        (f"{name}_without_offset", ~_blank(name) & ~F.col(name).rlike(OFFSET_TIME)),
        (f"{name}_impossible", F.col(name).rlike(OFFSET_TIME) & F.try_to_timestamp(F.col(name)).isNull()),
    ]


def snapshot_violations(snapshots: DataFrame) -> DataFrame:
    """snapshot_id and rule; snapshots: snapshot_id, observed_at as text and the fields of the measurement contract."""
    p = F.col("reliability_p")
    return check(
        snapshots,
        "snapshot_id",
        [
            *_time_rules("observed_at"),
            ("unit_unknown", ~F.coalesce(F.col("unit") == UNIT, F.lit(False))),
            ("reliability_out_of_range", ~F.coalesce((p > 0) & (p <= 1), F.lit(False))),
            ("scope_id_missing", _blank("scope_id")),
            ("assessment_method_missing", _blank("assessment_method")),
        ],
    )


def comparison_violations(comparisons: DataFrame, snapshots: DataFrame) -> DataFrame:
    """comparison_id and rule; comparisons: comparison_id, base_id, current_id. Contracts must be equal, field by field."""

    def side(name: str) -> DataFrame:
        fields = F.struct("observed_at", *CONTRACT).alias(name)
        return snapshots.select(F.col("snapshot_id").alias(f"{name}_id"), fields)

    both = comparisons.join(side("base"), "base_id", "left").join(side("current"), "current_id", "left")
    known = F.col("base").isNotNull() & F.col("current").isNotNull()
    rules = [("base_unknown", F.col("base").isNull()), ("current_unknown", F.col("current").isNull())]
    rules += [(f"{f}_differs", known & ~F.col(f"base.{f}").eqNullSafe(F.col(f"current.{f}"))) for f in CONTRACT]
    before = F.try_to_timestamp(F.col("current.observed_at")) < F.try_to_timestamp(F.col("base.observed_at"))
    return check(both, "comparison_id", [*rules, ("current_precedes_base", F.coalesce(before, F.lit(False)))])


def composition(weights: str) -> Column:
    """A mixture's weights in billionths, by family: equal for equal mixtures whatever their order."""
    entries = F.array_sort(F.map_entries(weights))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1e9).cast("long").cast("string"))), "|")


def grid_signatures(cells: DataFrame) -> DataFrame:
    """surface_id, subject, n and two sums of hashes over the distinct mixtures of a grid: equal grids have equal rows, without comparing them cell by cell."""
    once = cells.select("surface_id", "subject", composition("weights").alias("mix")).distinct()
    wide = [F.sum(F.xxhash64(F.lit(i), "mix").cast("decimal(38,0)")).alias(f"sum{i}") for i in (1, 2)]
    return once.groupBy("surface_id", "subject").agg(F.count(F.lit(1)).alias("n"), *wide)


def surface_violations(surfaces: DataFrame, cells: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """surface_id, subject, cell_index and rule of all that is wrong with surfaces.

    surfaces: surface_id, schema_version, method, families (array), grid_step. cells: surface_id, subject, cell_index, weights
    (map), support_status, sign_class, lower, median, upper, point_status, point_delta. Rules of a surface have no subject and cell.
    """
    step, fams = F.col("grid_step"), F.col("families")
    many = F.size(F.array_distinct("families")) == F.size("families")
    named = F.forall("families", lambda f: F.coalesce(f, F.lit("")) != "")
    own = check(
        surfaces,
        "surface_id",
        [
            ("schema_version_unsupported", ~F.col("schema_version").eqNullSafe(F.lit(VERSIONS["joint_surface"]))),
            ("method_unknown", ~F.col("method").eqNullSafe(F.lit(SURFACE_METHOD))),
            ("surface_id_missing", _blank("surface_id")),
            ("families_invalid", ~F.coalesce((F.size("families") >= 2) & many & named, F.lit(False))),
            ("grid_step_invalid", ~F.coalesce((step > 0) & (step < 1), F.lit(False))),
        ],
    )
    rows = cells.join(surfaces.select("surface_id", "families"), "surface_id", "left")
    values = F.map_values("weights")
    same = F.sort_array(F.map_keys("weights")) == F.sort_array(fams)
    finite = F.forall(values, lambda w: F.coalesce(_finite(w), F.lit(False)))
    fits = F.coalesce(same & finite, F.lit(False))
    inside = F.forall(values, lambda w: (w >= -tolerance) & (w <= 1 + tolerance))
    total = F.aggregate(values, F.lit(0.0), lambda a, w: a + w)
    supported = F.col("support_status").eqNullSafe(F.lit("supported"))
    banded = _finite(F.col("lower")) & _finite(F.col("median")) & _finite(F.col("upper"))
    each = check(
        rows.withColumn("cell", F.struct("surface_id", "subject", "cell_index")),
        "cell",
        [
            ("weights_not_of_families", ~fits),
            ("weight_out_of_range", fits & ~inside),
            ("weights_not_one", fits & inside & (F.abs(total - 1.0) > tolerance)),
            ("sign_class_invalid", ~F.coalesce(F.col("sign_class").isin(*SIGN_CLASSES), F.lit(False))),
            ("supported_without_class", supported & F.col("sign_class").eqNullSafe(F.lit("unsupported"))),
            ("band_missing", supported & ~banded),
            ("band_disordered", supported & banded & ((F.col("lower") > F.col("median")) | (F.col("median") > F.col("upper")))),
            ("point_unsupported", supported & ~F.col("point_status").eqNullSafe(F.lit("supported"))),
            ("point_delta_missing", supported & ~_finite(F.col("point_delta"))),
        ],
    ).select("cell.*", "rule")
    twice = (
        cells.groupBy("surface_id", "subject", composition("weights").alias("mix"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("cell_index").alias("cell_index"))
        .where("n > 1")
        .select("surface_id", "subject", "cell_index", F.lit("duplicate_composition").alias("rule"))
    )
    pair = grid_signatures(cells).groupBy("surface_id").agg(
        F.sort_array(F.collect_set("subject")).alias("subjects"), F.count_distinct("n", "sum1", "sum2").alias("grids")
    )
    pair = surfaces.select("surface_id").join(pair, "surface_id", "left")
    both = F.coalesce(F.col("subjects") == F.array(*map(F.lit, SUBJECTS)), F.lit(False))
    grids = check(pair, "surface_id", [("subjects_invalid", ~both), ("grids_differ", both & (F.col("grids") > 1))])
    none = [F.lit(None).cast("string").alias("subject"), F.lit(None).cast("long").alias("cell_index")]
    top = own.union(grids).select("surface_id", *none, "rule")
    return top.union(each).union(twice)


def trajectory_violations(observations: DataFrame, least: int = 3) -> DataFrame:
    """trajectory_id, position and rule; observations: trajectory_id, position, observation_id, geometry_id, observed_at as text.

    A repeated id is told at each of its places but the first, a time at the place where it doesn't go on.
    """
    by = Window.partitionBy("trajectory_id").orderBy("position")

    def again(name: str) -> Column:
        return F.row_number().over(Window.partitionBy("trajectory_id", name).orderBy("position")) > 1

    at = F.try_to_timestamp(F.col("observed_at"))
    rows = observations.withColumns({"at": at, "before": F.lag(at).over(by), "twice_o": again("observation_id"), "twice_g": again("geometry_id")})
    each = check(
        rows.withColumn("where", F.struct("trajectory_id", "position")),
        "where",
        [
            ("observation_id_missing", _blank("observation_id")),
            ("geometry_id_missing", _blank("geometry_id")),
            ("duplicate_observation_id", ~_blank("observation_id") & F.col("twice_o")),
            ("duplicate_geometry_id", ~_blank("geometry_id") & F.col("twice_g")),
            *_time_rules("observed_at"),
            ("time_not_increasing", F.coalesce(F.col("at") <= F.col("before"), F.lit(False))),
        ],
    ).select("where.*", "rule")
    few = observations.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    return each.union(few.select("trajectory_id", F.lit(None).cast(dict(observations.dtypes)["position"]), F.lit("too_few_observations")))
