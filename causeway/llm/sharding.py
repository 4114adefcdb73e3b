"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child draws ln(u) / weight, u a uniform in (0, 1) made from the hash of the document's id and the
child's name; the largest draw wins, so a child gets rows in proportion to its weight. A child's draw does not depend
on its siblings: where one weight grows, rows move only into that child's subtree, and where it shrinks, only out of it.
The descent reads a document's id and the tree alone.

Null ids hash as the empty name. Repeated ids all go to one shard. Texts that are null have size 8 and the checksum of
no bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKETS, keep_only, numbered


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def regular_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards filled in order into racks of per_rack, racks into regions of ``racks``: a full tree grows by a new region."""
    return [Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(shards)]


def _uniform(doc_id: Column, name: str) -> Column:
    """In (0, 1): 52 bits of the MD5 of "name:id"."""
    digest = F.md5(F.concat(F.lit(f"{name}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _draw(doc_id: Column, level: str, weights: dict[int, float]) -> Column:
    """The child that wins the weighted draw; ties, and there are none but by a hash's, go to the larger number."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [
        F.struct((F.log(_uniform(doc_id, f"{level}{child}")) / F.lit(w)).alias("draw"), F.lit(child).alias("child"))
        for child, w in sorted(weights.items())
    ]
    return F.greatest(*draws)["child"]


def descend(doc_id: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a document: three draws, one among the children of the chosen node at each level."""
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for leaf in tree:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[leaf.shard] = leaf.weight

    def among(level: str, children: dict[int, float], below: dict[int, Column]) -> Column:
        winner, out = _draw(doc_id, level, children), F.lit(None).cast("int")
        if len(below) == 1:
            return next(iter(below.values()))
        for child, column in below.items():
            out = F.when(winner == child, column).otherwise(out)
        return out

    return among(
        "region",
        {r: sum(w for rack in racks.values() for w in rack.values()) for r, racks in regions.items()},
        {
            r: among(
                "rack",
                {k: sum(leaves.values()) for k, leaves in racks.items()},
                {k: _draw(doc_id, "shard", leaves) for k, leaves in racks.items()},
            )
            for r, racks in regions.items()
        },
    ).cast("int")


def shard(docs: DataFrame, tree: Sequence[Leaf], grown: Sequence[Leaf] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless in each shard) and grown_shard, the shard in the grown tree."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = keep_only(docs, doc_id="long", text="string").select(
        "doc_id",
        (F.length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        descend(F.col("doc_id"), tree).alias("shard"),
        (descend(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    # numbered in buckets of the id's digest, so that no task holds a whole shard
    digest = F.md5(F.concat(F.lit("slot:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    bucket = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int") % BUCKETS
    return numbered(rows, "shard", "doc_id", "slot", bucket=bucket)
