"""Toxicity: a factorization machine over hashed terms.

A document is the set of its space-separated tokens, A-Z lower-cased. Each token has hashed terms: itself without
marks at its ends, and its prefixes of four to six characters, so that inflected forms share terms; a token of over
LONG characters, as in texts without spaces, has the hashed grams of LONG_GRAM characters all over it. The machine adds a
weight for each term and, for each pair of terms, the product of their factors; pairs such as an insult and the mention of
a group can so count for more, or less, than their sum.

Terms are learnt that tell the classes apart alone, and those that do so in a pair beyond what both do alone, whatever each
does by itself: all pairs of terms in ``min_share`` of the sample's documents are tested. Other terms of that frequency get
a faint weight, their log-count ratio times FAINT, that orders documents without any learnt term.

Null and empty texts have no terms: their score is the calibrated bias. Rows repeat as they come. Without labels
of both classes every score is the smoothed share of the positive class (0.5 with no labels at all). Columns other than
doc_id and text, names that differ from these in case alone included, are carried along unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .calibrate import fit_platt, sigmoid
from .common import labelled_sample

HASH_BITS = 20
#: Marks that are cut from the ends of a token.
MARKS = b".,;:!?%&$#*|\"'()[]{}<>-_"
CACHE = 300_000
LONG, LONG_GRAM = 64, 5
FAINT = 0.02
#: Terms in a step of the test of pairs.
STEP = 256


@dataclass
class Params:
    sample: int = 12_288  #: labelled documents to fit on, at most
    min_share: float = 0.02  #: of the sample's documents that a term must be in to be tested in pairs
    min_z: float = 4.0  #: a term's counts must differ between the classes by so many standard errors,
    min_pair_z: float = 8.0  #: or a pair's positives from what its terms let expect, to be learnt
    rank: int = 4
    epochs: int = 10
    warm: float = 0.2  #: share of a learnt term's log-count ratio that its weight starts from
    folds: int = 3  #: that the margins are calibrated across
    weight: float = 3.0  #: of a positive document's loss
    rate: float = 0.1
    l2: float = 1e-5
    seed: int = 7


@dataclass
class Machine:
    """term: sorted hashed terms; table: a weight and ``rank`` factors (0 if faint) for each. prior: the score where nothing was learnt."""

    term: np.ndarray
    table: np.ndarray
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0
    prior: float | None = None


def tokens(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").lower().split())


def terms_of(token: bytes) -> list[int]:
    w = token.strip(MARKS) or token
    mask = (1 << HASH_BITS) - 1
    s = w.decode("utf-8", "replace")
    if len(s) > LONG:
        grams = {s[i : i + LONG_GRAM] for i in range(len(s) - LONG_GRAM + 1)}
        return [zlib.crc32(g.encode("utf-8", "replace"), 9) & mask for g in grams]
    return [zlib.crc32(w, 1) & mask] + [zlib.crc32(s[:n].encode("utf-8", "replace"), n) & mask for n in (4, 5, 6) if len(s) > n]


def _sampled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[bytes, list[int]] = {}
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            if len(cache) > CACHE:
                cache.clear()
            ids: list[int] = []
            for t in tokens(text):
                if (x := cache.get(t)) is None:
                    x = cache[t] = terms_of(t)
                ids += x
            out.append(ids)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "y", "terms"]
        )


def _known_terms(term):
    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids in batch.column("terms"):
                ids = ids.values.to_numpy(zero_copy_only=False)
                at = np.searchsorted(term.value, ids)
                at[at == len(term.value)] = 0
                out.append(at[term.value[at] == ids].astype(np.int32) if len(term.value) else ids[:0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(out, pa.list_(pa.int32()))], batch.schema.names
            )

    return known


def fit(docs: DataFrame, labels: DataFrame, usable=None, params: Params | None = None) -> Machine:
    """Fit on at most about params.sample labelled documents; usable: which doc_ids' labels may be learnt."""
    p = params or Params()
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if usable is None else usable, p.sample)
    rows = sample.mapInArrow(_sampled_terms, "doc_id long, y int, terms array<int>")
    # a first pass counts, so that only the terms that get weights come to the driver
    per_doc = rows.select("doc_id", "y", F.array_distinct("terms").alias("terms"))
    n = {r["y"]: r["n"] for r in per_doc.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sum(v for k, v in n.items() if k == 1), sum(v for k, v in n.items() if k != 1)
    if not n1 or not n0:
        return Machine(np.zeros(0, np.int64), np.zeros((0, 1 + p.rank)), prior=(n1 + 1) / (n1 + n0 + 2))
    counts = (
        per_doc.select("y", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum((F.col("y") == 1).cast("long")).alias("c1"), F.sum((F.col("y") != 1).cast("long")).alias("c0"))
    )
    share = (F.col("c1") + F.col("c0")) / F.lit(n1 + n0)
    z = F.abs(F.col("c1") / F.lit(n1) - F.col("c0") / F.lit(n0)) / F.sqrt(
        F.greatest(share * (1 - share), F.lit(1e-12)) * F.lit(1 / n1 + 1 / n0)
    )
    # no more than the 2^HASH_BITS values that a term can have
    known = counts.where((F.col("c1") + F.col("c0") >= p.min_share * (n1 + n0)) | (z >= p.min_z)).withColumn("z", z).toArrow().sort_by("term")
    term = known.column("term").to_numpy().astype(np.int64)
    c1, c0, alone = (known.column(k).to_numpy().astype(float) for k in ("c1", "c0", "z"))
    # only the terms that have weights leave the executors, as rows of the table
    got = rows.mapInArrow(_known_terms(sample.sparkSession.sparkContext.broadcast(term)), rows.schema).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    y = (got.column("y").to_numpy()[order] == 1).astype(float)
    lists = got.column("terms").combine_chunks()
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    docs_terms = [flat[ends[i] : ends[i + 1]] for i in order]
    common = np.flatnonzero(c1 + c0 >= p.min_share * (n1 + n0))
    learnt = alone >= p.min_z
    learnt[common[in_pairs(docs_terms, y, common, p.min_pair_z)]] = True
    ratio = np.log((c1 + 1) / (n1 + 2) * (n0 + 2) / (c0 + 1))
    return _fit_machine(term, docs_terms, y, p, learnt, ratio)


def in_pairs(docs_terms: list[np.ndarray], y: np.ndarray, common: np.ndarray, min_z: float) -> np.ndarray:
    """Which of the common terms are in a pair whose positives differ from what the odds of both terms let expect."""
    n, k = len(y), len(common)
    at = np.full(int(max((x.max() for x in docs_terms if len(x)), default=0)) + 1 + (common.max() + 1 if k else 0), -1)
    at[common] = np.arange(k)
    held = np.zeros((n, k), np.uint8)
    for i, x in enumerate(docs_terms):
        own = at[x]
        held[i, own[own >= 0]] = 1
    found = np.zeros(k, bool)
    base, positive = (y.sum() + 1) / (n + 2), held[y == 1].sum(0, dtype=float)
    odds = np.log((positive + base) / (held.sum(0, dtype=float) - positive + 1 - base))

    def together(docs: np.ndarray, step: slice) -> np.ndarray:
        """How many of docs hold each term and each of a step's; a few documents are numbers at a time."""
        out = np.zeros((k, step.stop - step.start))
        for a in range(0, len(docs), 4 * STEP):
            part = docs[a : a + 4 * STEP].astype(np.float32)
            out += part.T @ part[:, step]
        return out

    for start in range(0, k, STEP):
        step = slice(start, min(k, start + STEP))
        both, hits = together(held, step), together(held[y == 1], step)
        expected = sigmoid(odds[:, None] + odds[None, step] - np.log(base / (1 - base)))
        z = np.abs(hits - both * expected) / np.sqrt(both * expected * (1 - expected) + 1.0)
        z[np.arange(step.start, step.stop), np.arange(step.stop - step.start)] = 0.0
        found |= (z >= min_z).any(1)
        found[step] |= (z >= min_z).any(0)
    return found


def _flat(docs_terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table, document of each)"""
    return (
        np.concatenate([np.zeros(0, np.int64), *docs_terms]).astype(np.int64),
        np.repeat(np.arange(len(docs_terms)), [len(x) for x in docs_terms]),
    )


def _margins(table: np.ndarray, bias: float, flat: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    w, v = table[flat, 0], table[flat, 1:]
    sums = np.stack([np.bincount(doc, v[:, k], n) for k in range(v.shape[1])], 1) if v.shape[1] else np.zeros((n, 0))
    pairs = 0.5 * ((sums**2).sum(1) - np.bincount(doc, (v**2).sum(1), n))
    return bias + np.bincount(doc, w, n) + pairs, sums


def _train(
    table: np.ndarray, docs_terms: list[np.ndarray], y: np.ndarray, p: Params, learnt: np.ndarray, offset: np.ndarray, chosen: np.ndarray
) -> tuple[np.ndarray, float]:
    """(table, bias) by AdaGrad on the logistic loss of the chosen documents, from a copy of table."""
    rng, table = np.random.default_rng(p.seed), table.copy()
    n, bias = len(chosen), float(np.log((y[chosen].sum() + 1) / (len(chosen) - y[chosen].sum() + 1)))
    seen, seen_bias = np.full(table.shape, 1e-6), 1e-6
    for _ in range(p.epochs if learnt.any() else 0):
        for batch in np.array_split(rng.permutation(chosen), max(1, n // 128)):
            flat, doc = _flat([docs_terms[i] for i in batch])
            margin, sums = _margins(table, bias, flat, doc, len(batch))
            g = (sigmoid(margin + offset[batch]) - y[batch]) * np.where(y[batch] == 1, p.weight, 1.0) / len(batch)
            grad = np.concatenate([g[doc][:, None], g[doc][:, None] * (sums[doc] - table[flat, 1:])], 1)
            rows, at = np.unique(flat, return_inverse=True)
            total = np.stack([np.bincount(at, grad[:, k], len(rows)) for k in range(grad.shape[1])], 1) + p.l2 * table[rows]
            seen[rows] += total**2
            table[rows] -= p.rate * total / np.sqrt(seen[rows])
            seen_bias += g.sum() ** 2
            bias -= p.rate * g.sum() / np.sqrt(seen_bias)
    return table, bias


def _fit_machine(term: np.ndarray, docs_terms: list[np.ndarray], y: np.ndarray, p: Params, learnt: np.ndarray, ratio: np.ndarray) -> Machine:
    """The machine of the whole sample, calibrated on margins that machines of the other folds give each fold.

    ratio: the terms' log-count ratios. A document with one telling term only is rare in a sample: weights that start from
    a share of the ratio find it without a longer training, which would learn the noise of others.
    """
    rng, n = np.random.default_rng(p.seed), len(y)
    faint = np.where(learnt, 0.0, FAINT * ratio)
    start = np.zeros((len(term), 1 + p.rank))
    start[:, 0] = np.where(learnt, p.warm * ratio, faint)
    start[learnt, 1:] = rng.normal(0, 0.05, (int(learnt.sum()), p.rank))
    moved = [x[learnt[x]] for x in docs_terms]
    offset = np.array([faint[x].sum() for x in docs_terms])

    def margins(table: np.ndarray, bias: float, docs: np.ndarray) -> np.ndarray:
        flat, doc = _flat([moved[i] for i in docs])
        return _margins(table, bias, flat, doc, len(docs))[0] + offset[docs]

    table, bias = _train(start, moved, y, p, learnt, offset, np.arange(n))
    fold = rng.permutation(n) % p.folds
    if n < 40:  # too few to leave any out
        margin = margins(table, bias, np.arange(n))
    else:
        margin = np.zeros(n)
        for k in range(p.folds):
            margin[fold == k] = margins(*_train(start, moved, y, p, learnt, offset, np.flatnonzero(fold != k)), np.flatnonzero(fold == k))
    a, b = fit_platt(np.arcsinh(margin), y)
    return Machine(term, table, bias, a, b)


class _Tokens:
    """What a document needs of each token: its weight, the sum of its factors and the sum of their squares. Bounded."""

    def __init__(self, model: Machine) -> None:
        self.known = {int(t): i for i, t in enumerate(model.term)}
        self.table, self.width = model.table, model.table.shape[1] + 1
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1024, self.width))

    def total(self, tokens: set[bytes]) -> np.ndarray:
        if len(self.at) > CACHE:
            self.at.clear()
        places = []
        for t in tokens:
            if (i := self.at.get(t)) is None:
                i = self.at[t] = len(self.at)
                if i >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                v = self.table[[self.known[x] for x in terms_of(t) if x in self.known]]
                self.rows[i, :-1], self.rows[i, -1] = v.sum(0), (v[:, 1:] ** 2).sum()
            places.append(i)
        return self.rows[places].sum(0)


def _scorer(model) -> object:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = model.value
        seen = _Tokens(m)
        for batch in batches:
            margin = []
            for text in batch.column("text").to_pylist():
                total = seen.total(tokens(text)) if m.prior is None else np.zeros(seen.width)
                margin.append(m.bias + total[0] + 0.5 * ((total[1:-1] ** 2).sum() - total[-1]))
            # the logarithmic scale keeps the order of margins of any size
            out = sigmoid(m.a * np.arcsinh(np.array(margin, float)) + m.b) if m.prior is None else np.full(len(margin), m.prior)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns)), pa.array(out, pa.float64())],
                [*batch.schema.names, "score"],
            )

    return score


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """docs with a column ``score``: the probability that the whole text is toxic. An own column of that name goes."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema, StructField("score", DoubleType())])
    return docs.mapInArrow(_scorer(shared), schema)
