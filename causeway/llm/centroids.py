"""Centroid clustering on integers: float32 screening with rigorous rounding-error intervals.

Vectors become integers floor(scale * x). A round multiplies a block of vectors by all centroids in float32. Each product
lies within gamma * |x| * |c| of the true one, whatever the order of summation (gamma from the unit roundoff and the number
of components), so each squared distance has an interval. A centroid whose interval ends below the others' beginnings is
the nearest; where intervals overlap, the shortlisted distances are computed again with exact integers, and of equal ones
the lowest number wins. A task returns exact sums and counts for its vectors, split into digits of 30 bits so that totals
stay exact at any number of rows; Spark adds them up, and only clusters x components of them reach the driver.

Components past what 64-bit squared distances bear (1.9e8 at 64 components) go by Python's integers and wider intervals: slower, but exact too. A distance, or a sum of
distances, that does not fit 64 bits is null. Vectors of another length, null ones and those with null or non-finite components are left out.
Repeated rows are vectors of their own. Rows of a null vec_id are clustered but never start a centroid, unless others
are too few; the order of equal start keys is that of their components. With fewer vectors than clusters there is a centroid for each
vector. Columns other than vec_id and embedding are not read, names that differ in case alone included. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_only

DIGIT = 30
#: Vectors multiplied at a time.
BLOCK = 8192
INTEGERS = "vec_id long, narrow binary, wide string"
ASSIGNED = "vec_id long, cluster int, distance long"


def to_integers(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    n, d = float(x).as_integer_ratio()
    return scale * n // d


def bound_of(dims: int) -> int:
    """Integers below it are narrow: 32 bits, and squared distances of 64."""
    return min(math.isqrt((1 << 61) // dims), (1 << 31) - 1)


def _integers(dims: int, scale: int):
    bound = bound_of(dims)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sized = np.array([n == dims for n in lists.value_lengths().to_pylist()], bool)
            batch = batch.filter(pa.array(sized))
            flat = batch.column("embedding").flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # a null is nan
            good = np.isfinite(x).all(1)
            x, ids = x[good], batch.column("vec_id").filter(pa.array(good))
            # a product by a power of two is exact, and others differ from the exact one by less than the guard
            narrow = (np.abs(x) < (bound - 2) / scale).all(1)
            exact = scale & (scale - 1) == 0
            out, wide = [None] * len(x), [None] * len(x)
            whole = np.floor(x[narrow] * scale).astype("<i4") if exact else None
            for k, i in enumerate(np.flatnonzero(narrow).tolist()):
                out[i] = whole[k].tobytes() if exact else np.array([to_integers(v, scale) for v in x[i]], "<i4").tobytes()
            for i in np.flatnonzero(~narrow).tolist():
                wide[i] = ",".join(str(to_integers(v, scale)) for v in x[i])
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary()), pa.array(wide, pa.string())], ["vec_id", "narrow", "wide"])

    return convert


class Centroids:
    """k centroids of Python integers, ready to find the nearest of blocks of vectors."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.rows, dims = rows, len(rows[0])
        self.bound = bound_of(dims)
        self.narrow = np.array([max(map(abs, c)) < self.bound for c in rows])
        self.whole = np.array([c if good else [0] * dims for c, good in zip(rows, self.narrow, strict=True)], np.int64)
        self.exact = np.array(rows, object)
        self.single = self.whole.astype(np.float32)
        # (n + 2) roundings on each term: two conversions, a product and at most n - 1 sums
        u = 2.0**-24
        self.gamma = (dims + 3) * u / (1 - (dims + 3) * u)
        self.square = np.array([float(sum(v * v for v in c)) if good else np.inf for c, good in zip(rows, self.narrow, strict=True)])
        self.norm = np.sqrt(self.square) * (1 + 1e-12)

    def shortlist(self, x: np.ndarray) -> np.ndarray:
        """Which centroids of each narrow vector may be the nearest. The squared length of the vector itself is left out of both ends."""
        about = (x.astype(np.float32) @ self.single.T).astype(np.float64)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
        with np.errstate(invalid="ignore", over="ignore"):
            middle = self.square[None, :] - 2.0 * about
            # roundings of the double precision steps are far below the 1e-12 shares
            off = 2.0 * self.gamma * (1 + 1e-12) * norm[:, None] * self.norm[None, :] + 1e-12 * (self.square[None, :] + 2.0 * np.abs(about)) + 1e-9
            low, high = middle - off, middle + off
        low[:, ~self.narrow], high[:, ~self.narrow] = -np.inf, np.inf
        return low <= high.min(1)[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of narrow vectors; distances are objects where a centroid is wide."""
        listed = self.shortlist(x)
        cluster = listed.argmax(1)
        open_ = np.flatnonzero(listed.sum(1) > 1)
        if len(open_):
            best = np.full(len(open_), -1, object if not self.narrow.all() else np.int64)
            for k in range(len(self.rows)):  # in ascending order, so that an equal distance changes nothing
                at = np.flatnonzero(listed[open_, k])
                d = self.distance(x[open_[at]], k)
                won = (best[at] < 0) | (d < best[at])
                best[at[won]], cluster[open_[at[won]]] = d[won], k
        distance = np.zeros(len(x), object if not self.narrow.all() else np.int64)
        for k in np.unique(cluster).tolist():
            at = cluster == k
            distance[at] = self.distance(x[at], k)
        return cluster, distance

    def distance(self, x: np.ndarray, k: int) -> np.ndarray:
        if self.narrow[k]:
            return ((x - self.whole[k]) ** 2).sum(1)
        return ((x.astype(object) - self.exact[k]) ** 2).sum(1)

    def nearest_exact(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for vectors of any integers, as objects."""
        d = np.stack([((x - c) ** 2).sum(1) for c in self.exact], 1)
        cluster = np.array([min(range(len(r)), key=lambda j, r=r: (r[j], j)) for r in d], np.int64)
        return cluster, d[np.arange(len(d)), cluster]


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows of the batch, their vectors, whether they are narrow)"""
    narrow = batch.column("narrow").is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(narrow)
    for a in range(0, len(at), BLOCK):
        rows = at[a : a + BLOCK]
        held = batch.column("narrow").take(pa.array(rows))
        yield rows, np.frombuffer(b"".join(held.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64), True
    rest = np.flatnonzero(~narrow)
    if len(rest):
        texts = batch.column("wide").take(pa.array(rest)).to_pylist()
        yield rest, np.array([[int(v) for v in t.split(",")] for t in texts], object).reshape(-1, dims), False


def _digits(total: int) -> list[int]:
    """Digits of DIGIT bits, lowest first; the last carries the sign."""
    out = []
    while not -(1 << DIGIT) <= total < (1 << DIGIT):
        out.append(total & ((1 << DIGIT) - 1))
        total >>= DIGIT
    return [*out, total]


def _totals(rows: list[list[int]]):
    """Rows (cluster, what, digit, part): what is a component, -1 the number of vectors, -2 the sum of distances."""
    dims = len(rows[0])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows)
        sums = [[0] * (dims + 2) for _ in rows]
        for batch in batches:
            for _, x, narrow in _blocks(batch, dims):
                cluster, distance = centroids.nearest(x) if narrow else centroids.nearest_exact(x)
                for k in np.unique(cluster).tolist():
                    at = cluster == k
                    part = [*x[at].sum(0).tolist(), int(at.sum()), sum(distance[at].tolist())]
                    sums[k] = [a + b for a, b in zip(sums[k], part, strict=True)]
        names = [*range(dims), -1, -2]
        out = [(k, w, d, v) for k, s in enumerate(sums) if s[dims] for w, total in zip(names, s, strict=True) for d, v in enumerate(_digits(total))]
        columns = zip(*out, strict=True) if out else [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cluster", "what", "digit", "part"])

    return totals


def _added_up(vectors: DataFrame, rows: list[list[int]]) -> list[dict[int, int]]:
    """For each cluster the exact totals of its vectors: at most clusters x (components + 2) x digits rows come back."""
    parts = vectors.mapInArrow(_totals(rows), "cluster int, what int, digit int, part long")
    out: list[dict[int, int]] = [{} for _ in rows]
    for r in parts.groupBy("cluster", "what", "digit").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        out[r.cluster][r.what] = out[r.cluster].get(r.what, 0) + (int(r.part) << (DIGIT * r.digit))
    return out


def _assigned(rows: list[list[int]]):
    dims = len(rows[0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows)
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), [0] * batch.num_rows
            for at, x, narrow in _blocks(batch, dims):
                found, d = centroids.nearest(x) if narrow else centroids.nearest_exact(x)
                cluster[at] = found
                for i, v in zip(at.tolist(), d.tolist(), strict=True):
                    distance[i] = v if v < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return assign


def _fits(total: int) -> int | None:
    return total if total < 1 << 63 else None


def cluster(vectors: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    Centroids start as the k vectors of the smallest sha256 of salt and vec_id. The integers are written once in the
    shared folder and read in each round.
    """
    schema = f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string"
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    named = keep_only(vectors, vec_id="long", embedding="array<double>")
    whole = scratch.put("vectors", named.mapInArrow(_integers(dims, scale), INTEGERS))
    first = (
        whole.withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256))
        .orderBy(F.col("h").asc_nulls_last(), F.hex("narrow").asc_nulls_last(), "wide").limit(k).toArrow()
    )
    rows = [x.tolist() for at, x, _ in _blocks(_one_batch(first), dims) for x in x]
    order = [i for at, _, _ in _blocks(_one_batch(first), dims) for i in at.tolist()]
    rows = [[int(v) for v in rows[order.index(i)]] for i in range(len(order))]
    if not rows:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        totals = _added_up(whole, rows)
        moved = [[t[i] // t[-1] for i in range(dims)] if t else row for t, row in zip(totals, rows, strict=True)]
        if moved == rows:  # nothing changes any more
            break
        rows = moved
    inertia = [t.get(-2, 0) for t in _added_up(whole, rows)]
    table = [
        (_fits(own), _fits(sum(inertia)), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for own, row in zip(inertia, rows, strict=True)
    ]
    facts = [F.element_at(F.array(*[F.lit(t[i]) for t in table]), F.col("cluster") + 1).cast(kind) for i, kind in enumerate(("long", "long", "string"))]
    out = whole.mapInArrow(_assigned(rows), ASSIGNED)
    return out.select("vec_id", "cluster", "distance", facts[0].alias("cluster_inertia"), facts[1].alias("inertia"), facts[2].alias("centroid_sha256"))


def _one_batch(table: pa.Table) -> pa.RecordBatch:
    batches = table.combine_chunks().to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], table.schema)
