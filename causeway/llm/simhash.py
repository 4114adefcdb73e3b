"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit set where over half of the hashes of a text's 3-word shingles have it set. Fingerprints link at
``reach`` or fewer differing bits. The 64 bits are grouped into parts; where part i may differ in t_i bits and the
t_i + 1 sum to reach + 1, any link agrees to within t_i on some part i. Bits that vary together go to one part, whose
values then spread least, and the t_i are allotted by dynamic programming over the estimated number of comparisons,
which comes from the number of fingerprints for each value of a part. A part with t_i of -1 is not probed at all.

Only distinct fingerprints are compared: copies share one. A fingerprint is looked up under its own part value by the
others, which probe with every value that differs in at most t_i bits; the distance is checked inside the join.

Null and empty texts, and texts of blanks, have the fingerprint zero and link like any other. Fewer than three words
make one shingle of all. A repeated doc_id is one node, whatever its texts. Null ids have a fingerprint and a null
component, and link nothing. Columns other than doc_id and text are not read, names that differ from these in case alone
included. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import components, cut, keep_only

BITS = 64
#: Shingles of a text that are hashed at a time.
CHUNK = 100_000
#: Cost of shuffling a probe, in comparisons.
PROBE_COST = 20.0
#: Fingerprints that bit correlations are estimated on; they set the grouping only, any grouping gives all links.
CORRELATION_SAMPLE = 20_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, CHUNK):
        part = words[start : min(n, start + CHUNK) + width - 1]
        if len(part) < width:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        h = np.array([digest(s, seed) for s in shingles], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        found = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
        keep = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in keep), pa.array(found)], [*(batch.schema.names[i] for i in keep), "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with the signed 64-bit column fp in place of text."""
    schema = StructType([*(f for f in docs.schema if f.name != "text"), StructField("fp", LongType())])
    return docs.mapInArrow(_fingerprints, schema)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits to parts of near-equal size, each bit to the part whose bits it varies with most."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    if len(bits) < 2:
        return [list(range(k, BITS, parts)) for k in range(parts)]
    dev = bits - bits.mean(0)
    sd = np.maximum(np.sqrt((dev**2).mean(0)), 1e-9)
    corr = np.abs(dev.T @ dev / len(bits) / sd / sd[:, None])
    sizes = [BITS // parts + (k < BITS % parts) for k in range(parts)]
    left, out = set(range(BITS)), []
    for size in sizes:
        first = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        group, gain = [first], corr[first].copy()
        left.discard(first)
        while len(group) < size:
            nxt = max(sorted(left), key=lambda b: gain[b])
            group.append(nxt)
            gain += corr[nxt]
            left.discard(nxt)
        out.append(sorted(group))
    return out


def part_value(group: list[int]):
    """The bits of a part, packed; a Column over fp."""
    value = F.lit(0).cast("long")
    # runs of neighbouring bits move together
    runs, start = [], 0
    for i in range(1, len(group) + 1):
        if i == len(group) or group[i] != group[i - 1] + 1:
            runs.append((group[start], i - start, start))
            start = i
    for low, size, to in runs:
        taken = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        value = value.bitwiseOR(F.shiftleft(taken, to))
    return value


def allot(cost: list[list[float]], reach: int) -> list[int]:
    """Thresholds t_i >= -1 with sum of (t_i + 1) = reach + 1 and the least total cost; cost[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for per_part in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(-1, len(per_part) - 1):
                total = used + t + 1
                if total <= reach + 1 and (total not in nxt or c + per_part[t + 1] < nxt[total][0]):
                    nxt[total] = c + per_part[t + 1], [*chosen, t]
        best = nxt
    return best[reach + 1][1]


def plan(distinct: DataFrame, reach: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part to probe. The counts behind the choice come from all fingerprints."""
    n = distinct.count()
    drawn = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < min(1 << 20, (CORRELATION_SAMPLE << 20) // max(n, 1)))
    sample = np.array([r["fp"] for r in drawn.collect()], np.int64).view(np.uint64)
    choices = []
    for parts in range(2, reach + 2):
        groups = group_bits(sample, parts)
        sums = [
            distinct.groupBy(part_value(g).alias("v")).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
            for g in groups
        ]
        cost = []
        for g, same in zip(groups, sums, strict=True):
            row = [0.0]
            for t in range(reach - parts + 2):
                probes = sum(comb(len(g), d) for d in range(t + 1))
                # values at a distance are taken to be as crowded as the value itself at most
                row.append((PROBE_COST * n + same / 2) * probes)
            cost.append(row)
        chosen = allot(cost, reach)
        total = sum(row[t + 1] for row, t in zip(cost, chosen, strict=True))
        choices.append((total, parts, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(choices)[2]


def links(distinct: DataFrame, reach: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most ``reach`` bits."""
    found = None
    for i, (group, t) in enumerate(plan(distinct, reach)):
        masks = [sum(1 << b for b in bits) for d in range(t + 1) for bits in combinations(range(len(group)), d)]
        kept = distinct.select(F.col("fp").alias("a"), part_value(group).alias("v"))
        probe = distinct.select(F.col("fp").alias("b"), part_value(group).alias("w"))
        if masks == [0]:
            probe = probe.withColumnRenamed("w", "v")
        else:
            flips = F.array(*[F.lit(m).cast("long") for m in masks])
            probe = probe.select("b", F.explode(F.transform(flips, lambda m: F.col("w").bitwiseXOR(m))).alias("v"))
        apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        pairs = kept.join(probe, (kept.v == probe.v) & (F.col("a") < F.col("b")) & (apart <= reach)).select("a", "b")
        found = pairs if found is None else found.union(pairs)
    return found.distinct()


def near_duplicates(docs: DataFrame, reach: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text)."""
    prints = cut(fingerprints(keep_only(docs, doc_id="long", text="string")))
    # the smallest id of each fingerprint stands for its copies
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    # the texts of one id are one node: their fingerprints hang together
    several = prints.where("doc_id is not null").select("doc_id", "fp").distinct()
    first = several.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a <> last")
    one_id = several.join(first, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b"))
    known = components(links(distinct.where("first_id is not null").select("fp"), reach).union(one_id))
    roots = distinct.join(known, distinct.fp == known.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root")
    )
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named_roots = roots.join(least, "root").select("fp", "component_id")
    out = prints.join(named_roots, "fp")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
