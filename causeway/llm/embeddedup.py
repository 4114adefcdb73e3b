"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors of cosine ``least`` or more are within eps = sqrt(2 - 2 * least). Vectors are turned to their leading
principal dimensions, put into cells of side eps there, and sorted by cell: the epsilon grid order. The sequence is cut
into intervals of bounded bytes, and runs of intervals make strips. Two strips meet in one task, to which each sends its
vectors once, so every vector travels as often as there are strips near its own: about the square root of the number of
tasks where all are near. In a task, intervals whose boxes in the leading dimensions are farther apart than eps are left
out; the others halve again and again, leaving out halves that are provably too far apart, and what remains is compared
by cosine in double precision. The principal dimensions come from a bounded sample; they set the order, not the result.

Equal vectors are one class, compared once. A meeting of strips returns for each class the number of vectors linked
and the links that join its components, never all pairs. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing. Vectors of other lengths are other spaces. Repeated vec_ids are vectors of their own for
n_links, and one node for components; rows of a null vec_id have a null component and are never kept. Columns other than
vec_id and embedding are not read, names that differ from these in case alone included. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut, keep_only

#: Vectors of an interval, at most; leading dimensions; size below which halves are compared outright.
INTERVAL, LEADING, SMALL = 2048, 6, 256
#: Bytes of vectors in a strip at most, as doubles: a task holds two strips.
STRIP_BYTES = 32 << 20
PCA_SAMPLE = 10_000


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal(sample: np.ndarray, leading: int) -> np.ndarray:
    """Columns: the directions of the largest spread."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])[:, :leading]
    _, directions = np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1))
    return directions[:, ::-1][:, :leading]


def _placer(axes: np.ndarray, eps: float):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            x = unit(flat.reshape(-1, len(axes))) @ axes if len(flat) else np.zeros((0, axes.shape[1]))
            cells = [pa.array(np.floor(x[:, k] / eps).astype(np.int32)) for k in range(x.shape[1])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns)), *cells],
                [*batch.schema.names, *(f"c{k}" for k in range(x.shape[1]))],
            )

    return place


def _boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.min(axis=0), x.max(axis=0)


def meet(a: np.ndarray, b: np.ndarray, xa: np.ndarray, xb: np.ndarray, least: float, same: bool):
    """Yield (rows of a, rows of b) of linked pairs; a and b are unit vectors, xa and xb their leading dimensions."""
    eps2 = 2 - 2 * least + 1e-9
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and a0 >= b1:
            continue
        la, ha = _boxes(xa[a0:a1])
        lb, hb = _boxes(xb[b0:b1])
        gap = np.maximum(0, np.maximum(la - hb, lb - ha))
        if (gap * gap).sum() > eps2:
            continue
        if max(a1 - a0, b1 - b0) > SMALL:
            ma, mb = (a0 + a1) // 2, (b0 + b1) // 2
            halves_a = [(a0, ma), (ma, a1)] if a1 - a0 > SMALL else [(a0, a1)]
            halves_b = [(b0, mb), (mb, b1)] if b1 - b0 > SMALL else [(b0, b1)]
            stack += [(*p, *q) for p in halves_a for q in halves_b]
            continue
        i, j = np.nonzero(a[a0:a1] @ b[b0:b1].T >= least)
        i, j = i + a0, j + b0
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def _ties(i: np.ndarray, j: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which of the links (i, j) join two trees of ``root``, which is brought up to date: all at once, again and again."""
    kept = []
    todo = np.arange(len(i))
    while True:
        a, b = root[i[todo]], root[j[todo]]
        todo = todo[a != b]
        if not len(todo):
            return np.concatenate(kept) if kept else todo
        a, b = root[i[todo]], root[j[todo]]
        high, low = np.maximum(a, b), np.minimum(a, b)
        # each root hangs under one smaller root, so there is no cycle; the links that did it are kept
        best = np.full(len(root), len(root), root.dtype)
        np.minimum.at(best, high, low)
        first = np.unique(high[best[high] == low], return_index=True)[1]
        kept.append(todo[np.flatnonzero(best[high] == low)[first]])
        hung = np.flatnonzero(best < len(root))
        parent = np.arange(len(root))
        parent[hung] = best[hung]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        root[:] = parent[root]


def _joined(axes: np.ndarray, least: float):
    """cls, other, links of the meeting of the two strips whose rows come together."""

    def rows(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("strip", *(f"c{k}" for k in range(axes.shape[1])), "cls")])
        strip = table.column("strip").to_numpy()
        cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy()
        v = unit(table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cls), -1))
        x = v @ axes
        same = strip[0] == strip[-1]
        edge = len(cls) if same else int(np.searchsorted(strip, strip[-1]))
        left = [(s, min(s + INTERVAL, edge)) for s in range(0, edge, INTERVAL)]
        right = left if same else [(s, min(s + INTERVAL, len(cls))) for s in range(edge, len(cls), INTERVAL)]
        links, root, tied = np.zeros(len(cls), np.int64), np.arange(len(cls)), []
        for a0, a1 in left:
            for b0, b1 in right:
                if same and b0 < a0:
                    continue
                for i, j in meet(v[a0:a1], v[b0:b1], x[a0:a1], x[b0:b1], least, a0 == b0):
                    i, j = i + a0, j + b0
                    links += np.bincount(i, n[j], len(cls)).astype(np.int64) + np.bincount(j, n[i], len(cls)).astype(np.int64)
                    new = _ties(i, j, root)
                    tied.append((cls[i[new]], cls[j[new]]))
        hit = np.flatnonzero(links)
        ca, cb = (np.concatenate([np.zeros(0, np.int64), *(t[s] for t in tied)]) for s in (0, 1))
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate([cls[hit], ca])),
                pa.array(np.concatenate([np.zeros(len(hit), np.int64), cb]), mask=np.r_[np.ones(len(hit), bool), np.zeros(len(cb), bool)]),
                pa.array(np.concatenate([links[hit], np.zeros(len(ca), np.int64)])),
            ],
            ["cls", "other", "links"],
        )

    return rows


def usable():
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _space(classes: DataFrame, dims: int, least: float) -> DataFrame:
    """cls, other, links: counts (other null) and component links among classes of vectors of one length."""
    n = classes.count()
    drawn = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < min(1 << 20, (PCA_SAMPLE << 20) // max(n, 1)))
    sample = np.array([r["embedding"] for r in drawn.select("embedding").collect()], np.float64).reshape(-1, dims)
    axes = principal(unit(sample) if len(sample) else sample, min(LEADING, dims))
    eps = float(np.sqrt(2 - 2 * least) + 1e-9)
    cells = [f"c{k}" for k in range(axes.shape[1])]
    schema = f"cls long, n long, embedding {dict(classes.dtypes)['embedding']}, " + ", ".join(f"{c} int" for c in cells)
    placed = classes.mapInArrow(_placer(axes, eps), schema)
    # as many strips as intervals in a strip, so tasks and what each vector sends grow with the square root of n
    size = int(min(max(1, STRIP_BYTES // (8 * dims)), max(INTERVAL, np.sqrt(n * INTERVAL)))) or 1
    ranged = placed.repartitionByRange(max(1, -(-n // INTERVAL)), *cells, "cls").withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*cells, "cls")) - 1))
    # a place in the whole order: the rows of the ranges before, one number for each range, and the place in the range
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    ordered = ranged.join(before, "_p").withColumn("strip", F.expr(f"(_before + _i) div {size}")).drop("_p", "_i", "_before")
    box = ordered.groupBy("strip").agg(*[F.min(c).alias(f"lo_{c}") for c in cells], *[F.max(c).alias(f"hi_{c}") for c in cells])
    # strips meet by the cells of the first two dimensions, each in those it spans and the ones after; few rows of numbers
    spread = box.withColumn("k0", F.explode(F.sequence("lo_c0", F.col("hi_c0") + 1)))
    keys = ["k0"]
    if len(cells) > 1:
        spread, keys = spread.withColumn("k1", F.explode(F.sequence("lo_c1", F.col("hi_c1") + 1))), ["k0", "k1"]
    left, right = (spread.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in box.columns]) for s in "ab")
    close = F.col("a_strip") <= F.col("b_strip")
    for c in cells:
        close = close & (F.col(f"a_lo_{c}") <= F.col(f"b_hi_{c}") + 1) & (F.col(f"b_lo_{c}") <= F.col(f"a_hi_{c}") + 1)
    pairs = cut(left.join(right, keys).where(close).select("a_strip", "b_strip").distinct())
    sent = pairs.select("a_strip", "b_strip", F.explode(F.array_distinct(F.array("a_strip", "b_strip"))).alias("strip"))
    met = ordered.join(sent, "strip").select("a_strip", "b_strip", "strip", *cells, "cls", "n", "embedding")
    return met.groupBy("a_strip", "b_strip").applyInArrow(_joined(axes, least), "cls long, other long, links long")


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding)."""
    # numbers travel as they come, and are compared as doubles
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    named = keep_only(vectors, vec_id="long", embedding=kind)
    good = named.where(usable()).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast(kind[6:-1])))
    classes = cut(
        good.groupBy("embedding")
        .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
        .select(F.monotonically_increasing_id().alias("cls"), "n", "first_id", "embedding")
    )
    found = None
    for row in classes.select(F.size("embedding").alias("d")).distinct().collect():
        part = _space(classes.where(F.size("embedding") == row["d"]).select("cls", "n", "embedding"), row["d"], least)
        found = part if found is None else found.union(part)
    alone = named.where(~usable() | F.col("embedding").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    if found is None:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    found = cut(found)
    counts = found.groupBy("cls").agg(F.sum("links").alias("linked"))
    # the vectors of one id are one node: its classes hang together
    several = good.join(classes.select("embedding", "cls"), "embedding").where("vec_id is not null").select("vec_id", "cls").distinct()
    first = several.groupBy("vec_id").agg(F.min("cls").alias("a"), F.max("cls").alias("last")).where("a <> last")
    one_id = several.join(first, "vec_id").where("cls <> a").select("a", F.col("cls").alias("b"))
    known = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")).union(one_id))
    named_classes = (
        classes.join(counts, "cls", "left")
        .join(known, classes.cls == known.node, "left")
        .select("embedding", "first_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("root"))
    )
    least_id = named_classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_class = named_classes.join(least_id, "root").select("embedding", "n_links", "component_id")
    linked = good.join(per_class, "embedding").select(
        "vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
