"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND, then overlap.

The index holds the items, the queries are the training passages: windows of whole texts, wide enough and overlapping
so far that any copy of an item lies inside one. A passage's score against an item is the item's BM25 weight of the
terms they share. Each item has a threshold of its own, the weight that must remain when the overlap test still passes:
no word outside the lost shingles can be missing, so no item that passes can score below it. Weights are divided by
their item's threshold, and every item with a score of 1 or more is retrieved; none is cut off by rank.

Posting lists are in item order and keep a maximum for each block of items. A passage moves one cursor through the list of
each of its terms, if any block's maxima over all its terms reach 1 at all: the pivot is the first item that the maxima of the lists up to its cursor could lift to 1; if the
maxima of the pivot's block cannot, all cursors before its end skip there, else the item is scored.

Retrieved items are verified: the five-word shingles of the item's question and of its answer must each lie in the
passage to ``overlap`` or more, or those of the whole item must. In an item of 5 to 28 words a single changed word can
void more of the shingles than that; there it is also enough that ``overlap`` of its words stand in their order in a
run of the passage that is no longer than the item's words divided by ``overlap``. A question is the text up to its last
"?", or else its first line if five words or more stand on both sides; or else the first half of the words. Fewer than
five words make one shingle.

The items are read in blocks of bounded size, one scan of the documents for each block, so the broadcast index is
bounded too. Items without words match nothing; null texts have none. A repeated item_id counts by its best row, a
repeated doc_id gives one row for each of its rows that leaks. Empty tables give empty results. Columns other than the
ids and texts are not read, names that differ from these in case alone included.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, place_of

SHINGLE = 5
BLOCK = 4  #: items in a block of the posting lists
K1, B = 1.2, 0.75
#: Where a cursor is that has left its list.
END = 1 << 62
#: Bytes of benchmark texts in one index.
INDEX_BYTES = 16 << 20
_words = re.compile(r"\w+").findall
#: Characters of a text whose words are held at a time.
CHUNK = 1 << 20
#: Items of fewer words can lose over a fifth of their shingles to one word.
SHORT = 29


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return set(zip(*(words[k:] for k in range(SHINGLE)), strict=False)) or {tuple(words)}


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    cuts = [text.rfind("?") + 1, text.find("\n") + 1]
    for at in cuts:
        a, b = words_of(text[:at]), words_of(text[at:])
        if at and min(len(a), len(b)) >= SHINGLE:
            return a, b
    words = words_of(text)
    half = (len(words) + 1) // 2
    return (words[:half], words[half:]) if len(words) >= 2 * SHINGLE else (words, [])


def _ranges(starts: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Places of all entries of the lists."""
    first, size = starts[lists], starts[lists + 1] - starts[lists]
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """items: (item_id, text). Weights are relative to their item's threshold."""

    def __init__(self, items: list[tuple[int, str]], overlap: float) -> None:
        self.overlap = overlap
        self.ids = [i for i, _ in items]
        self.parts = [tuple(shingles(p) for p in question_and_answer(t or "")) for _, t in items]
        words = [words_of(t) for _, t in items]
        self.whole = [shingles(w) for w in words]
        self.short = [w if SHINGLE <= len(w) < SHORT else None for w in words]
        lengths = [len(w) for w in words]
        mean = max(1.0, sum(lengths) / max(1, len(lengths)))
        df = Counter(t for w in words for t in set(w))
        postings: dict[str, list[tuple[int, float]]] = {}
        for item, ws in enumerate(words):
            weight = {
                t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5))
                * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean))
                for t, tf in Counter(ws).items()
            }
            # as many words can be missing as shingles; a few more where shingles repeat
            parts = self.parts[item]
            may_lose = sum(int((1 - overlap) * len(p) + 1e-9) for p in parts)
            if may_lose and sum(map(len, parts)) < len(ws) - sum((SHINGLE - 1) * bool(p) for p in parts):
                may_lose += 2 * (SHINGLE - 1)
            # of the whole: a missing word's first shingle begins with it, but for the last four words
            whole = self.whole[item]
            repeats = len(whole) < len(ws) - (SHINGLE - 1)
            may_lose = max(may_lose, int((1 - overlap) * len(whole) + 1e-9) + repeats * (SHINGLE - 1))
            if self.short[item]:
                may_lose = max(may_lose, int((1 - overlap) * len(ws) + 1e-9))
            lost = sum(sorted(weight.values(), reverse=True)[:may_lose])
            total = sum(weight.values())
            floor = max(total - lost, 1e-3 * total) * (1 - 1e-9)
            for t, w in weight.items():
                postings.setdefault(t, []).append((item, w / floor))
        # of each term its items in order, their weights, and the largest weight of each block of items
        self.top = {t: max(w for _, w in p) for t, p in postings.items()}
        self.terms = frozenset(postings)
        self.lists = {}
        for t, p in postings.items():
            best: dict[int, float] = {}
            for i, w in p:
                best[i // BLOCK] = max(w, best.get(i // BLOCK, 0.0))
            self.lists[t] = [i for i, _ in p], [w for _, w in p], best
        # the blocks of all lists, one list after the other
        self.term = {t: i for i, t in enumerate(self.lists)}
        self.block_at = np.cumsum([0, *(len(x[2]) for x in self.lists.values())])
        self.block = np.array([b for x in self.lists.values() for b in x[2]], np.int64)
        self.block_top = np.array([w for x in self.lists.values() for w in x[2].values()])
        #: longest item, and so how far passages overlap
        self.stride = max(64, 2 * max(lengths, default=0))

    def search(self, terms: set[str]) -> list[tuple[int, float]]:
        """(item, score) of every item that scores 1 or more, by block-max WAND."""
        if sum(map(self.top.__getitem__, terms)) < 1.0:
            return []
        # most passages end here: no block can reach 1, which one look at all blocks tells
        lists = np.fromiter(map(self.term.__getitem__, terms), np.int64, len(terms))
        at = _ranges(self.block_at, lists)
        if np.bincount(self.block[at], self.block_top[at]).max() < 1.0:
            return []
        # a cursor: the item it stands at, the list's maximum, its place in the list, and the list
        cursors = [[self.lists[t][0][0], self.top[t], 0, *self.lists[t]] for t in terms]
        found = []
        while True:
            cursors.sort(key=lambda c: c[0])
            bound, last = 0.0, -1
            for last, c in enumerate(cursors):
                bound += c[1]
                if bound >= 1.0:
                    break
            else:
                return found
            pivot = cursors[last][0]
            while last + 1 < len(cursors) and cursors[last + 1][0] == pivot:
                last += 1
            block = pivot // BLOCK
            if sum(c[5].get(block, 0.0) for c in cursors[: last + 1]) < 1.0:
                # nothing up to the end of the block, or to the next cursor, can reach 1
                target = min((block + 1) * BLOCK, cursors[last + 1][0] if last + 1 < len(cursors) else (block + 1) * BLOCK)
            elif cursors[0][0] == pivot:
                score = sum(c[4][c[2]] for c in cursors[: last + 1])
                if score >= 1.0:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for c in cursors[: last + 1]:
                if c[0] < target:
                    c[2] = bisect_left(c[3], target, c[2])
                    c[0] = c[3][c[2]] if c[2] < len(c[3]) else END
            cursors = [c for c in cursors if c[0] < END]

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """item: (score, overlap of question, of answer) of the items that a text holds; the best passage of each."""
        found: dict[int, tuple[float, float, float]] = {}
        stride, left = self.stride, []
        for words in pieces_of(text):
            words = left + words
            for start in range(0, max(1, len(words) - stride), stride):
                passage = words[start : start + 2 * stride]
                terms = self.terms.intersection(passage)
                if not terms:
                    continue
                hits = self.search(terms)
                if not hits:
                    continue
                held = shingles(passage)
                for item, score in hits:
                    parts = self.parts[item]
                    if not parts[0]:
                        continue
                    q, a = (len(p & held) / len(p) if p else 1.0 for p in parts)
                    if len(parts[0]) == 1 and len(next(iter(parts[0]))) < SHINGLE:
                        q = float(_contains(passage, next(iter(parts[0]))))
                    if not (q >= self.overlap and a >= self.overlap):
                        whole, short = self.whole[item], self.short[item]
                        if len(whole & held) < self.overlap * len(whole) - 1e-9 or len(whole) < 2:
                            if not short or not _in_order(short, passage, self.overlap):
                                continue
                    if (score, q, a) > found.get(item, (0.0, 0.0, 0.0)):
                        found[item] = score, q, a
            left = words[-stride:]
        return found


def _in_order(item: list[str], words: list[str], overlap: float) -> bool:
    """Whether a run of at most len(item) / overlap words holds ``overlap`` of the item's words in their order."""
    need, size = math.ceil(overlap * len(item) - 1e-9), int(len(item) / overlap + 1e-9)
    known = set(item)
    at = [i for i, w in enumerate(words) if w in known]
    for k in range(len(at) - need + 1):
        if at[k + need - 1] - at[k] >= size:
            continue
        best = [0] * (len(item) + 1)
        for w in words[at[k] : at[k] + size]:
            before = 0
            for j, x in enumerate(item, 1):
                here = best[j]
                best[j] = before + 1 if w == x else max(here, best[j - 1])
                before = here
        if best[-1] >= need:
            return True
    return False


def _contains(words: list[str], run: tuple[str, ...]) -> bool:
    return any(tuple(words[i : i + len(run)]) == run for i in range(len(words) - len(run) + 1))


def pieces_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text, some at a time; no word is broken."""
    text, at = text or "", 0
    while at < len(text):
        to = at + CHUNK
        while to < len(text) and (text[to - 1].isalnum() or text[to - 1] == "_"):
            to += 1
        yield words_of(text[at:to])
        at = to


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _leak_rows(shared, kind: pa.DataType):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                best: dict[int, tuple] = {}
                for item, how in index.leaks(text).items():
                    best[index.ids[item]] = max(how, best.get(index.ids[item], how))
                out += [(doc_id, item_id, *how) for item_id, how in sorted(best.items())]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (kind, pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in LEAKS.split(", ")]
            )

    return rows


def _found(named: DataFrame, benchmark: DataFrame, overlap: float, index_bytes: int) -> DataFrame:
    """Leaks of (doc_id, text); doc_id is a long or a string."""
    items = keep_only(benchmark, item_id="long", text="string").where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()
    )
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // index_bytes)
    text = dict(named.dtypes)["doc_id"] == "string"
    schema, kind = LEAKS.replace("doc_id long", "doc_id string") if text else LEAKS, pa.string() if text else pa.int64()
    spark = named.sparkSession
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        index = Index(sorted((r["item_id"], r["text"]) for r in part.collect()), overlap)
        found = named.mapInArrow(_leak_rows(spark.sparkContext.broadcast(index), kind), schema)
        out = found if k == 0 else out.union(found)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every item that a document holds."""
    return _found(keep_only(docs, doc_id="long", text="string"), benchmark, overlap, index_bytes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8) -> DataFrame:
    """docs without the rows whose doc_id leaks an item; rows of a null doc_id are judged by their own text."""
    names = docs.columns
    placed = docs.toDF(*[f"_{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"_{place_of(docs, c)}") for c in ("doc_id", "text"))
    keyed = placed.withColumn("key", F.coalesce(doc_id.cast("long").cast("string"), F.sha2(text.cast("string"), 256)))
    leaking = _found(keyed.select(F.col("key").alias("doc_id"), text.cast("string").alias("text")), benchmark, overlap, INDEX_BYTES)
    kept = keyed.join(leaking.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti")
    return kept.select(*placed.columns).toDF(*names)
