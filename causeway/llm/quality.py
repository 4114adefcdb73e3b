"""Quality: naive-Bayes support vectors.

A document is the set of its n-grams: tokens, pairs of neighbouring tokens, and pairs and triples of shapes. A shape is
the token's letter case and the marks it ends with, or a sign of its own where a token repeats the one before. Each n-gram's
indicator is scaled by the logarithm of the ratio of its smoothed class counts; a linear model with hinge loss is
then fitted by dual coordinate descent, and its margins are calibrated on documents it has not seen.

Null and empty texts have no n-grams: their score is the calibrated bias. Rows repeat as they come. Without labels
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
CACHE = 300_000
#: Tokens of a text that are turned into Python objects at a time.
CHUNK = 200_000


@dataclass
class Params:
    sample: int = 8_192  #: labelled documents to fit on, at most
    c: float = 0.5
    epochs: int = 20
    min_docs: int = 3  #: n-grams in fewer documents of the sample have no weight
    smooth: float = 1.0
    seed: int = 11


@dataclass
class Model:
    weight: np.ndarray  #: of each hashed n-gram, already scaled by its log-count ratio
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0
    prior: float | None = None


def shape_of(token: str) -> str:
    core = token.rstrip(".,;:!?%&$#*|\"'()[]{}<>-_=+/\\@^~")
    tail = token[len(core) :]
    if not core:
        return "." + tail
    kind = "d" if core[0].isdigit() else "U" if len(core) > 1 and core.isupper() else "C" if core[0].isupper() else "l"
    return kind + tail


def _mixed(seed: int, *parts: np.ndarray) -> np.ndarray:
    """One hash of HASH_BITS bits from the 32-bit hashes of each part."""
    h = np.full(len(parts[0]), seed, np.uint64)
    for x in parts:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


#: Shapes before the first token, and of a token that repeats the one before.
START, SAME = np.uint64(1), np.uint64(2)


class Grams:
    """Hashed n-grams of texts; remembers the hashes of a bounded number of tokens."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        """The 32-bit hashes of each word (low half) and of its shape (high half)."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen, out = self.seen, []
        for w in words:
            if (x := seen.get(w)) is None:
                raw = w.encode("utf-8", "replace")
                x = seen[w] = zlib.crc32(raw, 1) | zlib.crc32(shape_of(w).encode("utf-8", "replace"), 3) << 32
            out.append(x)
        return np.array(out, np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        words, found = (text or "").split(), [np.zeros(0, np.int64)]
        word_before, shapes_before = np.zeros(1, np.uint64), np.array([START, START])
        for start in range(0, len(words), CHUNK):
            both = self._hashes(words[start : start + CHUNK])
            word = np.concatenate([word_before, both & np.uint64(0xFFFFFFFF)])
            shape = np.where(word[1:] == word[:-1], SAME, both >> np.uint64(32))
            shape = np.concatenate([shapes_before, shape])
            grams = [_mixed(1, word[1:]), _mixed(2, word[:-1], word[1:]), _mixed(3, shape[1:-1], shape[2:]), _mixed(4, shape[:-2], shape[1:-1], shape[2:])]
            found.append(np.unique(np.concatenate(grams)))
            word_before, shapes_before = word[-1:], shape[-2:]
        return np.unique(np.concatenate(found))


def _sampled_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        out = [grams.of(t).astype(np.int32) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "y", "grams"]
        )


def fit(docs: DataFrame, labels: DataFrame, usable=None, params: Params | None = None) -> Model:
    """Fit on at most about params.sample labelled documents; usable: which doc_ids' labels may be learnt."""
    p = params or Params()
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if usable is None else usable, p.sample)
    got = sample.mapInArrow(_sampled_grams, "doc_id long, y int, grams array<int>").toArrow()
    ids = np.asarray(got.column("doc_id").to_numpy())
    order = np.argsort(ids, kind="stable")
    y = (np.asarray(got.column("y").to_numpy())[order] == 1).astype(int)
    lists = got.column("grams").combine_chunks()
    rows = [np.asarray(lists[int(i)].values.to_numpy(zero_copy_only=False), np.int64) for i in order]
    return fit_rows(rows, y, p)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, p: Params) -> Model:
    size, n1, n0 = 1 << HASH_BITS, int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return Model(np.zeros(0), prior=(n1 + 1) / (n1 + n0 + 2))
    rng = np.random.default_rng(p.seed)
    held = rng.permutation(len(y)) % 4 == 0 if len(y) >= 40 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    counts = np.zeros((2, size))
    for i in train:
        counts[y[i], rows[i]] += 1
    one, none = counts[1] + p.smooth, counts[0] + p.smooth
    ratio = np.log((one / one.sum()) / (none / none.sum()))
    ratio[counts.sum(0) < p.min_docs] = 0
    used = [r[ratio[r] != 0] for r in rows]
    value = [ratio[r] / np.sqrt(max(1.0, (ratio[r] ** 2).sum())) for r in used]
    # dual coordinate descent for the squared-bias-augmented hinge loss; classes weigh alike
    sign, cost = np.where(y == 1, 1.0, -1.0), np.where(y == 1, p.c * len(y) / (2 * n1), p.c * len(y) / (2 * n0))
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    norm = np.array([(v**2).sum() + 1.0 for v in value])
    for _ in range(p.epochs):
        moved = 0.0
        for i in rng.permutation(train):
            g = sign[i] * (w[used[i]] @ value[i] + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[used[i]] += step * value[i]
                bias += step
                moved, alpha[i] = max(moved, abs(step)), new
        if moved < 1e-3:
            break
    at = np.flatnonzero(held) if held.any() else train
    margin = np.array([w[used[i]] @ value[i] + bias for i in at])
    a, b = fit_platt(margin, y[at])
    return Model(np.stack([w * ratio, ratio**2]).astype(np.float32), bias, a, b)


def _scorer(model) -> object:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        grams = Grams()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if m.prior is not None:
                    out.append(m.prior)
                    continue
                at = grams.of(text)
                total = m.weight[:, at].sum(1, dtype=np.float64)
                margin = total[0] / np.sqrt(max(1.0, total[1])) + m.bias
                out.append(float(sigmoid(np.float64(m.a * margin + m.b))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns)), pa.array(out, pa.float64())],
                [*batch.schema.names, "score"],
            )

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column ``score``: the probability that the whole text is good. An own column of that name goes."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema, StructField("score", DoubleType())])
    return docs.mapInArrow(_scorer(shared), schema)
