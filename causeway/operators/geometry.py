"""Geometry of grid surfaces: adjacency, components, crossings, gradients; their drift and trajectories.

A surface row is (obs, subject, cell, units, supported, sign_class, lower, upper, delta). Cells are integer units, so
neighbours are generated and equi-joined, not compared all with all. A surface's components go to one grouped task for
each (obs, subject): grids are bounded by their parameters.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import ratio, sign_of

TOLERANCE = 1e-12
SIDES = ("supported", "sign_class", "lower", "upper", "delta")


def edges(surface: DataFrame, units_total: int = 10) -> DataFrame:
    """Neighbouring cells a < b (one unit from one family to another) with the values of both; each edge once."""
    a = surface.select("obs", "subject", F.col("cell").alias("cell_a"), F.col("units").alias("units_a"), *[F.col(c).alias(f"{c}_a") for c in SIDES])
    places = F.sequence(F.lit(0), F.size("units_a") - 1)
    moved = (
        a.where(F.size("units_a") > 1).withColumn("_i", F.explode(places)).withColumn("_j", F.explode(places)).where("_i <> _j")
        .withColumn("units_b", F.transform("units_a", lambda u, at: u + F.when(at == F.col("_i"), 1).when(at == F.col("_j"), -1).otherwise(0)))
        .drop("_i", "_j")
    )
    b = surface.select(
        F.col("obs").alias("_o"), F.col("subject").alias("_s"), F.col("cell").alias("cell_b"), F.col("units").alias("_u"),
        *[F.col(c).alias(f"{c}_b") for c in SIDES],
    )
    same = (F.col("obs") == F.col("_o")) & (F.col("subject") == F.col("_s")) & (F.col("units_b") == F.col("_u"))
    return moved.join(b, same & (F.col("cell_a") < F.col("cell_b"))).drop("_o", "_s", "_u").withColumn(
        "transfer", F.lit(1.0 / units_total)
    )


def _components(pdf: pd.DataFrame) -> dict[str, str]:
    """Smallest cell reachable, for each cell; pdf: cells, and their neighbours of the same group or null."""
    parent = {c: c for c in pdf["cell"]}

    def root(c: str) -> str:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for a, b in zip(pdf["cell"], pdf["other"], strict=True):
        if isinstance(b, str):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {c: root(c) for c in parent}


def components(surface: DataFrame, by_sign: bool = False) -> DataFrame:
    """obs, subject, grp, cell, component: connected supported cells, or those of one sign class, numbered by smallest cell."""
    grp = F.col("sign_class") if by_sign else F.lit("supported")
    cells = surface.where("supported").select("obs", "subject", grp.alias("grp"), "cell", F.lit(None).cast("string").alias("other"))
    near = edges(surface).where("supported_a and supported_b")
    if by_sign:
        near = near.where("sign_class_a = sign_class_b")
    ga = F.col("sign_class_a") if by_sign else F.lit("supported")
    linked = near.select("obs", "subject", ga.alias("grp"), F.col("cell_a").alias("cell"), F.col("cell_b").alias("other"))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _components(pdf)
        number = {r: i for i, r in enumerate(sorted(set(found.values())))}
        first = pdf.iloc[0]
        cells = sorted(found)
        return pd.DataFrame(
            {"obs": first["obs"], "subject": first["subject"], "grp": first["grp"], "cell": cells, "component": [number[found[c]] for c in cells]}
        )

    both = cells.union(linked)
    return both.groupBy("obs", "subject", "grp").applyInPandas(label, "obs int, subject string, grp string, cell string, component long")


def isolated(surface: DataFrame) -> DataFrame:
    """Supported cells without a supported neighbour."""
    near = edges(surface).where("supported_a and supported_b")
    linked = near.select("obs", "subject", F.col("cell_a").alias("cell")).union(near.select("obs", "subject", "cell_b"))
    return surface.where("supported").select("obs", "subject", "cell").join(linked, ["obs", "subject", "cell"], "left_anti")


def support_boundary(surface: DataFrame) -> DataFrame:
    """Edges with exactly one supported end."""
    return edges(surface).where(F.col("supported_a") != F.col("supported_b")).select("obs", "subject", "cell_a", "cell_b", "supported_a")


def sign_boundary(surface: DataFrame) -> DataFrame:
    e = edges(surface).where("supported_a and supported_b and sign_class_a <> sign_class_b")
    return e.select("obs", "subject", "cell_a", "cell_b", "sign_class_a", "sign_class_b")


def gradients(surface: DataFrame) -> DataFrame:
    e = edges(surface).where("supported_a and supported_b")
    return e.select(
        "obs", "subject", "cell_a", "cell_b",
        *[((F.col(f"{c}_b") - F.col(f"{c}_a")) / F.col("transfer")).alias(f"{c}_slope") for c in ("delta", "lower", "upper")],
    )


def crossings(surface: DataFrame) -> DataFrame:
    """Edges where the lower band leaves the positive side, or the upper band the negative: fraction and units there."""
    e = edges(surface).where("supported_a and supported_b")
    out = None
    for field, sign in (("lower", 1), ("upper", -1)):
        va, vb = F.col(f"{field}_a"), F.col(f"{field}_b")
        stable_a, stable_b = sign * va > TOLERANCE, sign * vb > TOLERANCE
        raw = F.when(F.abs(va) <= TOLERANCE, 0.0).when(F.abs(vb) <= TOLERANCE, 1.0).when(va * vb < 0, -va / (vb - va))
        part = (
            e.where(stable_a != stable_b)
            .withColumn("fraction", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
            .where(raw.isNotNull())
            .select(
                "obs", "subject", F.lit(field).alias("field"), "cell_a", "cell_b", "fraction",
                F.zip_with("units_a", "units_b", lambda a, b: (1 - F.col("fraction")) * a + F.col("fraction") * b).alias("at"),
            )
        )
        out = part if out is None else out.union(part)
    return out


def summary(surface: DataFrame) -> DataFrame:
    """Cells of each class and the range of band widths of each surface."""
    width = F.col("upper") - F.col("lower")
    return surface.groupBy("obs", "subject").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if("supported").alias("n_supported"),
        *[F.count_if(F.col("sign_class") == c).alias(f"n_{c}") for c in ("positive_band", "negative_band", "zero_band", "crosses_zero")],
        F.min(width).alias("min_width"),
        F.max(width).alias("max_width"),
    )


def steps(surface: DataFrame) -> DataFrame:
    """Each cell at one observation and the next: full outer, as supported or not."""
    cols = ["cell", "supported", "sign_class", "delta"]
    a = surface.select("obs", "subject", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = surface.select((F.col("obs") - 1).alias("b_obs"), F.col("subject").alias("b_subject"), *[F.col(c).alias(f"b_{c}") for c in cols])
    last = surface.agg(F.max("obs").alias("last"))
    same = (F.col("obs") == F.col("b_obs")) & (F.col("subject") == F.col("b_subject")) & (F.col("a_cell") == F.col("b_cell"))
    out = a.join(b, same, "full_outer").select(
        F.coalesce("obs", "b_obs").alias("step"),
        F.coalesce("subject", "b_subject").alias("subject"),
        F.coalesce("a_cell", "b_cell").alias("cell"),
        F.coalesce("a_supported", F.lit(False)).alias("was"),
        F.coalesce("b_supported", F.lit(False)).alias("now"),
        F.coalesce("a_sign_class", F.lit("unsupported")).alias("from_class"),
        F.coalesce("b_sign_class", F.lit("unsupported")).alias("to_class"),
    )
    return out.join(F.broadcast(last)).where((F.col("step") >= 0) & (F.col("step") < F.col("last"))).drop("last")


def domain_motion(surface: DataFrame) -> DataFrame:
    moved = steps(surface).groupBy("step", "subject").agg(
        F.count_if(F.col("was") & F.col("now")).alias("persistent"),
        F.count_if(~F.col("was") & F.col("now")).alias("gained"),
        F.count_if(F.col("was") & ~F.col("now")).alias("lost"),
    )
    union = F.col("persistent") + F.col("gained") + F.col("lost")
    return moved.withColumn("jaccard", F.coalesce(ratio(F.col("persistent"), union), F.lit(1.0)))


def sign_migration(surface: DataFrame) -> DataFrame:
    both = steps(surface).where("was and now")
    return both.groupBy("step", "subject", "from_class", "to_class").agg(F.count(F.lit(1)).alias("n"))


#: The classes that a supported cell can have.
CLASSES = ("positive_band", "negative_band", "crosses_zero", "zero_band")


def class_turnover(surface: DataFrame) -> DataFrame:
    """Cells that each step gains or loses, and those that stay in their class or change it, for all four classes, zeros included."""
    now = surface.select((F.col("obs") - 1).alias("obs"), "subject", "cell", F.col("supported").alias("now"), F.col("sign_class").alias("to_class"))
    both = surface.select("obs", "subject", "cell", F.col("supported").alias("was"), F.col("sign_class").alias("from_class")).join(now, ["obs", "subject", "cell"])
    each = both.withColumn("class", F.explode(F.array(*map(F.lit, CLASSES))))
    before, after = F.col("was") & (F.col("from_class") == F.col("class")), F.col("now") & (F.col("to_class") == F.col("class"))
    return each.groupBy(F.col("obs").alias("step"), "subject", "class").agg(
        F.count_if(~F.col("was") & after).alias("gained"), F.count_if(before & ~F.col("now")).alias("lost"),
        F.count_if(before & after).alias("kept"), F.count_if(before & F.col("now") & ~after).alias("left"),
    )


def component_motion(surface: DataFrame) -> DataFrame:
    """Cells shared by each component and each of the next observation, and whether it splits or merges."""
    c = components(surface).select("obs", "subject", "cell", "component")
    nxt = c.select((F.col("obs") - 1).alias("obs"), "subject", "cell", F.col("component").alias("next_component"))
    links = c.join(nxt, ["obs", "subject", "cell"]).groupBy("obs", "subject", "component", "next_component").agg(F.count(F.lit(1)).alias("shared"))
    out = F.count(F.lit(1)).over(Window.partitionBy("obs", "subject", "component"))
    into = F.count(F.lit(1)).over(Window.partitionBy("obs", "subject", "next_component"))
    return links.select(F.col("obs").alias("step"), "subject", "component", "next_component", "shared", (out > 1).alias("splits"), (into > 1).alias("merges"))


def closest_pairs(a: np.ndarray, b: np.ndarray, a_keys: list[str], b_keys: list[str], radius: float = 0.5) -> list[tuple[int, int, float]]:
    """(row of a, row of b, distance): always the closest pair left by L1 distance to nine decimals, then by the keys of both.

    Pairs within a radius are decided by such pairs alone, so only those are looked for, in the lattice cells around each
    point; what is still open meets again at twice the radius. Never all pairs at once, but where all are near.
    """
    left_a, left_b, out = np.arange(len(a)), np.arange(len(b)), []
    reach = float(np.abs(a).sum(1).max() + np.abs(b).sum(1).max()) if len(a) and len(b) else 0.0
    rank_a, rank_b = (np.argsort(np.argsort(np.array(k, object), kind="stable"), kind="stable") for k in (a_keys, b_keys))
    while len(left_a) and len(left_b) and radius <= 4 * reach + 4:
        cells_a, cells_b = (np.floor(x[:, : max(1, x.shape[1] - 1)] / radius).astype(np.int64) for x in (a[left_a], b[left_b]))
        low = np.minimum(cells_a.min(0), cells_b.min(0)) - 1
        size = np.maximum(cells_a.max(0), cells_b.max(0)) - low + 2
        step = np.concatenate([np.cumprod(size[::-1])[::-1][1:], [1]])
        code_b = (cells_b - low) @ step
        order = np.argsort(code_b, kind="stable")
        code_b, found = code_b[order], []
        for move in itertools.product((-1, 0, 1), repeat=cells_a.shape[1]):
            code = (cells_a - low + np.array(move)) @ step
            first, last = np.searchsorted(code_b, code), np.searchsorted(code_b, code, side="right")
            n = last - first
            i = np.repeat(np.arange(len(code)), n)
            j = order[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            d = np.round(np.abs(b[left_b[j]] - a[left_a[i]]).sum(1), 9)
            near = d <= radius - 1e-6
            found.append((left_a[i[near]], left_b[j[near]], d[near]))
        i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
        used_a, used_b = set(), set()
        for k in np.lexsort((rank_b[j], rank_a[i], d)).tolist():
            x, y = int(i[k]), int(j[k])
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                out.append((x, y, float(d[k])))
        left_a, left_b = (np.array([x for x in left.tolist() if x not in used], np.int64) for left, used in ((left_a, used_a), (left_b, used_b)))
        radius *= 2
    return out


def greedy_matches(crossed: DataFrame) -> DataFrame:
    """Crossings of one observation matched to the next: always the closest pair left, by L1 distance of their units.

    The points of two observations meet in one task for each (step, subject, field); a grid's size bounds them. Points of one place are
    points of their own.
    """

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["step", "subject", "field", "a_key", "b_key", "distance"]
        if a.empty or b.empty:
            return pd.DataFrame(columns=names)
        at = (np.array(x.tolist(), float).reshape(len(x), -1) for x in (a["at"], b["at_b"]))
        ka, kb = a["key"].tolist(), b["key_b"].tolist()
        rows = [(a["obs"].iloc[0], a["subject"].iloc[0], a["field"].iloc[0], ka[i], kb[j], d) for i, j, d in closest_pairs(*at, ka, kb)]
        return pd.DataFrame(rows, columns=names)

    def points(obs: Column, tag: str) -> DataFrame:
        # the sides of a cogroup come from one table: each needs names of its own
        key = F.concat("cell_a", F.lit(">"), "cell_b")
        return crossed.select(*[c.alias(f"{n}{tag}") for n, c in (("obs", obs), ("subject", F.col("subject")), ("field", F.col("field")), ("key", key), ("at", F.col("at")))])

    now, nxt = points(F.col("obs"), ""), points(F.col("obs") - 1, "_b")
    return now.groupBy("obs", "subject", "field").cogroup(nxt.groupBy("obs_b", "subject_b", "field_b")).applyInPandas(
        match, "step int, subject string, field string, a_key string, b_key string, distance double"
    )


def gradient_drift(surface: DataFrame) -> DataFrame:
    g = gradients(surface).select("obs", "subject", "cell_a", "cell_b", "delta_slope")
    last = surface.agg((F.max("obs") - 1).alias("_last"))
    nxt = g.select((F.col("obs") - 1).alias("obs"), "subject", "cell_a", "cell_b", F.col("delta_slope").alias("next_slope"), F.lit(True).alias("_b"))
    both = g.withColumn("_a", F.lit(True)).join(nxt, ["obs", "subject", "cell_a", "cell_b"], "full_outer").join(F.broadcast(last))
    status = F.when(F.col("_a") & F.col("_b"), "matched").when(F.col("_b"), "appeared").otherwise("disappeared")
    return both.where("obs between 0 and _last").select(
        F.col("obs").alias("step"), "subject", "cell_a", "cell_b", status.alias("status"), (F.col("next_slope") - F.col("delta_slope")).alias("slope_change")
    )


def _reversals(signs: Column) -> Column:
    """Flips between neighbours of an array of signs, zeros and nulls left out."""
    s = F.filter(signs, lambda x: x != 0)
    return F.size(F.filter(F.transform(s, lambda x, i: F.when(i > 0, x != F.get(s, i - 1))), lambda x: x)).cast("long")


def support_trajectory(surface: DataFrame) -> DataFrame:
    counts = surface.groupBy("subject", "obs").agg(F.count_if("supported").alias("n"))
    change = F.col("n") - F.lag("n").over(Window.partitionBy("subject").orderBy("obs"))
    rows = counts.withColumn("change", change)
    seq = F.transform(F.array_sort(F.collect_list(F.struct("obs", "n", "change"))), lambda x: x["change"])
    return rows.groupBy("subject").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obs", "n"))), lambda x: x["n"].cast("string")), ",").alias("counts"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.count_if(F.expr("change > 0")).alias("expansions"),
        F.count_if(F.expr("change < 0")).alias("contractions"),
        F.count_if(F.expr("change = 0")).alias("flat_steps"),
        _reversals(F.transform(seq, lambda x: sign_of(x))).alias("reversals"),
    )


def sign_persistence(surface: DataFrame) -> DataFrame:
    """For each cell supported at least once, the classes it goes through over all observations."""
    obs = surface.select("obs").distinct()
    cells = surface.where("supported").select("subject", "cell").distinct()
    state = surface.where("supported").select("obs", "subject", "cell", "sign_class")
    full = cells.join(F.broadcast(obs)).join(state, ["obs", "subject", "cell"], "left").withColumn("sign_class", F.coalesce("sign_class", F.lit("unsupported")))
    seq = F.transform(F.array_sort(F.collect_list(F.struct("obs", "sign_class"))), lambda x: x["sign_class"])
    rows = full.groupBy("subject", "cell").agg(seq.alias("s"))
    support = F.transform("s", lambda x: x != "unsupported")
    excursion = F.exists(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("s") - 2)), lambda i: (F.size("s") > 2) & (F.get(support, i - 1) == F.get(support, i + 1)) & (F.get(support, i) != F.get(support, i - 1))),
        lambda x: x,
    )
    runs = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("best")),
        lambda a, x: F.struct(
            F.when(x == "positive_band", a["now"] + 1).otherwise(0).alias("now"),
            F.greatest(a["best"], F.when(x == "positive_band", a["now"] + 1).otherwise(0)).alias("best"),
        ),
        lambda a: a["best"],
    )
    return rows.select(
        "subject",
        "cell",
        F.array_join("s", ",").alias("statuses"),
        F.size(F.filter("s", lambda x: x != "unsupported")).cast("long").alias("n_supported"),
        F.size(F.filter(F.transform("s", lambda x, i: F.when(i > 0, x != F.get(F.col("s"), i - 1))), lambda x: x)).cast("long").alias("n_changes"),
        F.coalesce(excursion, F.lit(False)).alias("support_excursion"),
        runs.alias("longest_positive_run"),
    )


def gradient_trajectory(surface: DataFrame) -> DataFrame:
    g = gradients(surface).select("obs", "subject", "cell_a", "cell_b", "delta_slope")
    n_obs = surface.agg(F.countDistinct("obs").alias("n_obs"))
    w = Window.partitionBy("subject", "cell_a", "cell_b").orderBy("obs")
    change = F.when(F.lag("obs").over(w) == F.col("obs") - 1, F.col("delta_slope") - F.lag("delta_slope").over(w))
    rows = g.withColumn("change", change).groupBy("subject", "cell_a", "cell_b").agg(
        F.count(F.lit(1)).alias("n_present"),
        F.max(F.abs("change")).alias("max_abs_change"),
        _reversals(F.transform(F.array_sort(F.collect_list(F.when(F.col("change").isNotNull(), F.struct("obs", "change")))), lambda x: sign_of(x["change"]))).alias("reversals"),
    )
    return rows.join(F.broadcast(n_obs)).select("subject", "cell_a", "cell_b", "n_present", (F.col("n_present") == F.col("n_obs")).alias("persistent"), "max_abs_change", "reversals")


def boundary_lineages(matches: DataFrame, crossed: DataFrame) -> DataFrame:
    """Chains of matched crossings over the observations: lineage (its first node), nodes and span of each."""
    key = F.concat("cell_a", F.lit(">"), "cell_b")
    nodes = crossed.select("subject", "field", F.concat_ws("@", F.lpad(F.col("obs").cast("string"), 4, "0"), key).alias("cell"), F.lit(None).cast("string").alias("other"))
    tied = matches.select(
        "subject", "field",
        F.concat_ws("@", F.lpad(F.col("step").cast("string"), 4, "0"), "a_key").alias("cell"),
        F.concat_ws("@", F.lpad((F.col("step") + 1).cast("string"), 4, "0"), "b_key").alias("other"),
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _components(pdf)
        rows = pd.DataFrame({"lineage": list(found.values()), "obs": [int(c.split("@")[0]) for c in found]})
        out = rows.groupby("lineage")["obs"].agg(["count", "min", "max"]).reset_index()
        out.columns = ["lineage", "n_nodes", "first_obs", "last_obs"]
        out.insert(0, "field", pdf["field"].iloc[0])
        out.insert(0, "subject", pdf["subject"].iloc[0])
        return out

    return nodes.union(tied).groupBy("subject", "field").applyInPandas(
        chain, "subject string, field string, lineage string, n_nodes long, first_obs long, last_obs long"
    )


def frontier_motion(surface: DataFrame) -> DataFrame:
    """Edges of the support boundary that stay, come and go from each observation to the next."""
    e = support_boundary(surface).select("obs", "subject", "cell_a", "cell_b")
    here = e.withColumn("_a", F.lit(1))
    nxt = e.select((F.col("obs") - 1).alias("obs"), "subject", "cell_a", "cell_b", F.lit(1).alias("_b"))
    last = surface.agg((F.max("obs") - 1).alias("_last"))
    both = here.join(nxt, ["obs", "subject", "cell_a", "cell_b"], "full_outer").join(F.broadcast(last)).where("obs between 0 and _last")
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.groupBy(F.col("obs").alias("step"), "subject").agg(
        F.count_if(a & b).alias("persistent"), F.count_if(~a & b).alias("gained"), F.count_if(a & ~b).alias("lost")
    )


def component_lineages(surface: DataFrame) -> DataFrame:
    """Components tied over the observations by shared cells: lineage (its first node), nodes, span, splits and merges."""
    def node(obs: Column, component: Column) -> Column:
        return F.concat_ws("@", F.lpad(obs.cast("string"), 4, "0"), F.lpad(component.cast("string"), 4, "0"))

    c = components(surface).select("obs", "subject", node(F.col("obs"), F.col("component")).alias("cell")).distinct()
    motion = component_motion(surface)
    ties = motion.select(
        "subject", node(F.col("step"), F.col("component")).alias("cell"), node(F.col("step") + 1, F.col("next_component")).alias("other"), "splits", "merges"
    )
    nodes = c.select("subject", "cell", F.lit(None).cast("string").alias("other"), F.lit(False).alias("splits"), F.lit(False).alias("merges"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _components(pdf)
        rows = pd.DataFrame({"lineage": list(found.values()), "obs": [int(x.split("@")[0]) for x in found]})
        out = rows.groupby("lineage")["obs"].agg(["count", "min", "max"]).reset_index()
        out.columns = ["lineage", "n_nodes", "first_obs", "last_obs"]
        tied = pdf[pdf["other"].notna()].assign(lineage=lambda x: x["cell"].map(found))
        for name, side in (("splits", "cell"), ("merges", "other")):
            n = tied[tied[name]].groupby("lineage")[side].nunique()
            out[f"n_{name}"] = out["lineage"].map(n).fillna(0).astype("int64")
        out.insert(0, "subject", pdf["subject"].iloc[0])
        return out

    return nodes.union(ties).groupBy("subject").applyInPandas(
        chain, "subject string, lineage string, n_nodes long, first_obs long, last_obs long, n_splits long, n_merges long"
    )


def boundary_motion(matches: DataFrame, days_per_step: float) -> DataFrame:
    """Velocity of each matched crossing, and its acceleration where the match goes on in the next step."""
    v = matches.withColumn("velocity", F.col("distance") / days_per_step)
    nxt = v.select((F.col("step") - 1).alias("step"), "subject", "field", F.col("a_key").alias("b_key"), F.col("velocity").alias("next_velocity"))
    return v.join(nxt, ["step", "subject", "field", "b_key"], "left").select(
        "step", "subject", "field", "a_key", "b_key", "velocity", ((F.col("next_velocity") - F.col("velocity")) / days_per_step).alias("acceleration")
    )
