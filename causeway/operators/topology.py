"""Causal topology of event ledgers: edges, integrity of the graph, depth, critical path, reachability, width.

Events carry run_id, event_id, ledger_seq, parent_seqs and a weight. Relational parts are joins and aggregations over all
runs at once. Depth and path need a run's order and go to one grouped task for each run, linear in its events and edges. The
closure goes to blocks of bounded bits; matching, which needs all of it, has a bound that raises.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a task's closure: 64 MB.
TASK_BITS = 1 << 29


def edges(events: DataFrame) -> DataFrame:
    """One row for each (parent, child) of a run; a parent that is listed twice gives two rows."""
    child = events.select("run_id", F.col("ledger_seq").alias("child_seq"), F.explode("parent_seqs").alias("parent_seq"))
    return child.select("run_id", "parent_seq", "child_seq")


def violations(events: DataFrame) -> DataFrame:
    """run_id, ledger_seq, rule of each broken rule: repeated ids or places, self-parents, unknown or later parents."""
    seq_twice = events.groupBy("run_id", "ledger_seq").count().where("count > 1").select("run_id", "ledger_seq", F.lit("duplicate_ledger_seq").alias("rule"))
    id_twice = (
        events.groupBy("run_id", "event_id").agg(F.count(F.lit(1)).alias("n"), F.min("ledger_seq").alias("ledger_seq"))
        .where("n > 1")
        .select("run_id", "ledger_seq", F.lit("duplicate_event_id").alias("rule"))
    )
    e = edges(events)
    own = e.where("parent_seq = child_seq").select("run_id", F.col("child_seq").alias("ledger_seq"), F.lit("self_parent").alias("rule"))
    later = e.where("parent_seq > child_seq").select("run_id", F.col("child_seq").alias("ledger_seq"), F.lit("parent_not_before").alias("rule"))
    known = events.select("run_id", F.col("ledger_seq").alias("parent_seq")).distinct()
    unknown = e.join(known, ["run_id", "parent_seq"], "left_anti").select(
        "run_id", F.col("child_seq").alias("ledger_seq"), F.lit("unknown_parent").alias("rule")
    )
    return seq_twice.union(id_twice).union(own).union(later).union(unknown).distinct()


def nodes(events: DataFrame) -> DataFrame:
    """In- and out-degree of each event and whether it is a root, leaf, branch or join."""
    ins = F.size("parent_seqs").cast("long")
    outs = edges(events).groupBy("run_id", F.col("parent_seq").alias("ledger_seq")).agg(F.count(F.lit(1)).alias("out_degree"))
    out = F.coalesce("out_degree", F.lit(0).cast("long"))
    return events.join(outs, ["run_id", "ledger_seq"], "left").select(
        "run_id",
        "ledger_seq",
        "event_id",
        ins.alias("in_degree"),
        out.alias("out_degree"),
        (ins == 0).alias("is_root"),
        (out == 0).alias("is_leaf"),
        (out > 1).alias("is_branch"),
        (ins > 1).alias("is_join"),
    )


def _topological(parents: dict[int, list[int]]) -> list[int]:
    """Kahn's order, the least ready place first among those freed together; raises on a cycle or an unknown parent."""
    children: dict[int, list[int]] = {n: [] for n in parents}
    waits = {}
    for n, ps in parents.items():
        waits[n] = len(ps)
        for p in ps:
            if p not in children:
                raise ValueError(f"unknown parent {p} of {n}")
            children[p].append(n)
    ready, out = deque(sorted(n for n, w in waits.items() if not w)), []
    while ready:
        n = ready.popleft()
        out.append(n)
        for c in children[n]:
            waits[c] -= 1
            if not waits[c]:
                ready.append(c)
    if len(out) < len(parents):
        raise ValueError("the graph has a cycle")
    return out


def _graph(pdf: pd.DataFrame) -> tuple[list[int], dict[int, list[int]]]:
    parents = {int(s): [int(p) for p in ps] for s, ps in zip(pdf["ledger_seq"], pdf["parent_seqs"], strict=True)}
    return _topological(parents), parents


def _distances(order: list[int], parents: dict[int, list[int]], weight: dict[int, float]) -> dict[int, float]:
    far: dict[int, float] = {}
    for n in order:
        far[n] = max((far[p] for p in parents[n]), default=0.0) + weight[n]
    return far


def _longest(order: list[int], parents: dict[int, list[int]], weight: dict[int, float]) -> list[int]:
    """Of the longest paths the one of the smallest sequence of places: from its smallest start always to the smallest
    next node that can still end at full depth, and no further than it must."""
    far = _distances(order, parents, weight)
    depth = max(far.values())
    leads = {n for n in order if far[n] == depth}
    ends, onward = set(leads), {}
    for n in reversed(order):
        if n in leads:
            for p in parents[n]:
                if far[p] + weight[n] == far[n]:
                    leads.add(p)
                    onward[p] = min(n, onward.get(p, n))
    path = [min(n for n in leads if not parents[n])]
    while path[-1] not in ends:
        path.append(onward[path[-1]])
    return path


def summary(events: DataFrame, weight: str = "machine_runtime_ms") -> DataFrame:
    """work, depth, parallelism and the counts of each run."""
    per_node = nodes(events)
    counts = per_node.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum("in_degree").alias("n_edges"),
        *[F.count_if(f"is_{k}").alias(f"n_{name}") for k, name in (("root", "roots"), ("leaf", "leaves"), ("branch", "branches"), ("join", "joins"))],
    )

    def deepest(pdf: pd.DataFrame) -> pd.DataFrame:
        order, parents = _graph(pdf)
        w = dict(zip(pdf["ledger_seq"].astype(int), pdf["w"].astype(float), strict=True))
        return pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]], "work": [float(sum(w[n] for n in sorted(w)))], "depth": [max(_distances(order, parents, w).values())]})

    slim = events.select("run_id", "ledger_seq", "parent_seqs", F.coalesce(F.col(weight), F.lit(0.0)).alias("w"))
    deep = slim.groupBy("run_id").applyInPandas(deepest, "run_id string, work double, depth double")
    return counts.join(deep, "run_id").withColumn("parallelism", F.when(F.col("depth") != 0, F.col("work") / F.col("depth")))


def critical_path(events: DataFrame, weight: str = "machine_runtime_ms") -> DataFrame:
    """run_id, step (from 1) and ledger_seq of each run's longest path."""

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        order, parents = _graph(pdf)
        found = _longest(order, parents, dict(zip(pdf["ledger_seq"].astype(int), pdf["w"].astype(float), strict=True)))
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "step": range(1, len(found) + 1), "ledger_seq": found})

    slim = events.select("run_id", "ledger_seq", "parent_seqs", F.coalesce(F.col(weight), F.lit(0.0)).alias("w"))
    return slim.groupBy("run_id").applyInPandas(path, "run_id string, step long, ledger_seq long")


def _closure(order: list[int], parents: dict[int, list[int]]) -> dict[int, int]:
    """Descendants of each node as a bit set over the order."""
    at = {n: i for i, n in enumerate(order)}
    below = dict.fromkeys(order, 0)
    for n in reversed(order):
        for p in parents[n]:
            below[p] |= below[n] | 1 << at[n]
    return below


def reachability(events: DataFrame, task_bits: int = TASK_BITS) -> DataFrame:
    """Number of descendants and ancestors of each event.

    A run is dealt into blocks of ancestors: each task has the run's edges, and a bit for each event of its block at each
    event. A block is as large as ``task_bits`` allow, so a run of up to about 23,000 events is one block, and one of a million
    goes in bounded tasks of its own kind.
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        order, parents = _graph(pdf)
        size = int(pdf["size"].iloc[0])
        first = int(pdf["block"].iloc[0]) * size
        at = {n: i for i, n in enumerate(order[first : first + size])}
        above: dict[int, int] = {}
        below = [0] * len(at)
        for n in order:
            bits = 0
            for p in parents[n]:
                bits |= above[p] | (1 << at[p] if p in at else 0)
            above[n] = bits
        ancestors = [above[n].bit_count() for n in order]
        step = 64
        for low in range(0, len(at), step):  # bits of a few ancestors at a time, over all events
            mask = (1 << step) - 1
            part = np.array([above[n] >> low & mask for n in order], np.uint64)
            for i in range(min(step, len(at) - low)):
                below[low + i] = int((part >> np.uint64(i) & np.uint64(1)).sum())
        return pd.DataFrame(
            {"run_id": pdf["run_id"].iloc[0], "ledger_seq": order, "below": [below[at[n]] if n in at else 0 for n in order], "above": ancestors}
        )

    slim = events.select("run_id", "ledger_seq", "parent_seqs")
    n = F.count(F.lit(1))
    size = F.greatest(F.lit(64), F.floor(F.lit(task_bits) / n)).cast("long")
    blocks = slim.groupBy("run_id").agg(size.alias("size"), F.ceil(n / size).cast("int").alias("blocks"))
    dealt = slim.join(blocks, "run_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = dealt.groupBy("run_id", "block").applyInPandas(count, "run_id string, ledger_seq long, below long, above long")
    return parts.groupBy("run_id", "ledger_seq").agg(F.sum("below").alias("n_descendants"), F.sum("above").alias("n_ancestors"))


def _matching(below: list[int]) -> int:
    """Maximum bipartite matching of nodes to their descendants, by augmenting paths over bit sets, without recursion."""
    owner: dict[int, int] = {}
    for start in range(len(below)):
        seen, came, todo = 0, {}, [start]
        end = -1
        while todo and end < 0:
            u = todo.pop()
            fresh = below[u] & ~seen
            seen |= fresh
            while fresh:
                v = (fresh & -fresh).bit_length() - 1
                fresh &= fresh - 1
                came[v] = u
                if v not in owner:
                    end = v
                    break
                todo.append(owner[v])
        if end >= 0:
            took = {u: v for v, u in owner.items()}
            v = end
            while True:
                u = came[v]
                before = took.get(u)
                owner[v] = u
                if u == start:
                    break
                v = before
    return len(owner)


def width(events: DataFrame, task_bits: int = TASK_BITS) -> DataFrame:
    """The largest number of events of a run none of which precedes another (Dilworth: nodes less matched nodes).

    The matching needs the whole closure of a run at once: a run whose n x n bits pass ``task_bits`` is an error that says so.
    """

    def widest(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) ** 2 > task_bits:
            raise ValueError(f"run {pdf['run_id'].iloc[0]} has {len(pdf)} events: its closure passes {task_bits} bits; give more task_bits")
        order, parents = _graph(pdf)
        below = _closure(order, parents)
        return pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]], "width": [len(order) - _matching([below[n] for n in order])]})

    slim = events.select("run_id", "ledger_seq", "parent_seqs")
    return slim.groupBy("run_id").applyInPandas(widest, "run_id string, width long")
