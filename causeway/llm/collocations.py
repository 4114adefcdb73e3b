"""Phrase collocations by a minimal perfect hash over Apriori-safe candidates.

Texts are tokenized once: a written table holds, for chunks of one lang, the distinct words with their counts and the 64-bit hashes of
lang and word, and all words in order as numbers of these, with a zero between pieces. From there on all is numpy over hashes.

A phrase is a candidate only if its words and its shorter parts may be frequent. Occurrences of pairs go to slices by hash and
are sifted there (equal hashes of different pairs only let more pass); pairs that pass, then triples whose two pairs pass, are
kept as bitmaps of bounded size, four bits of one word for each, that never lose a frequent one. The candidates, with the frequent words, get a minimal
perfect hash; tasks build it in parts, the driver only passes these on. Mappers look up every pair and triple that the bitmaps let pass; as candidates are all
that these let pass, each has a slot and no key need be stored. The slots are counted in numpy arrays, which are summed as a tree with the words' counts. Frequencies and
those of the parts at each cut are then read by slot. Candidates of more than ``slice_keys`` go in several slices, a pass each, so that what is broadcast stays bounded.

Distinct words are told apart by a second hash; if two of one lang share the first, all is done anew with another seed.

A null lang is ``und``; null and empty texts have no words. Rows repeat as they come, each counts. Columns other than lang and text are
not read, names that differ from these in case alone included. Without candidates, and for empty tables, the result is empty.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, keep_only, shuffles_released

#: Marks that end a piece, as one byte each; all become line feeds, which no word can hold.
ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(10 if b in ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words of a chunk, about; occurrences of a sifting slice, about; bits of a bitmap at most (16 MB).
CHUNK, SIFTED, MOST_BITS = 1 << 19, 1 << 21, 27
#: Bytes of text that are taken apart at a time.
STEP = 1 << 20
#: Slots whose counts make one row on the way to the sum.
ROW_SLOTS = 1 << 15
SEEDS = 4
#: Keys of a part of a perfect hash, about; binary logarithm of the bits of a piece of a bitmap. A task makes these, and the driver passes them on.
PART_KEYS, PIECE_BITS = 1 << 16, 20
#: Keys of candidates that a task holds before it sends them on.
HELD = 1 << 19
#: Bits of a bitmap for each of its hashes, as long as there is room; other hashes that pass are candidates in vain.
SPARSE = 64
#: Rows of megabytes: the writer looks at the size of its pages and groups at each row, not first after a hundred.
WIDE_ROWS = {
    "compression": "zstd", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
}
KEY = ["h1", "h2", "h3"]
WORDS = "lang string, code long, places binary, words binary, word_hashes binary, counts binary, n long"

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
U = np.uint64


def mix(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray | None, seed: int = 0) -> np.ndarray:
    """One 64-bit hash of up to three, in order."""
    with np.errstate(over="ignore"):
        x = (h1 ^ (U(seed) * _M[3])) * _M[0]
        x = ((x ^ (x >> U(29))) + h2) * _M[1]
        x ^= x >> U(32)
        if h3 is not None:
            x = (x + h3) * _M[2]
            x ^= x >> U(31)
        x *= _M[3]
        return x ^ (x >> U(32))


#: Bytes of a hash that occurrences are sifted by: fewer bits let more pass, and lose nothing.
SIFT_BYTES = 6


def sift_hash(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray | None) -> np.ndarray:
    return mix(h1, h2, h3) >> U(64 - 8 * SIFT_BYTES)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The lowest SIFT_BYTES of each, as rows of bytes."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIFT_BYTES]


def _widen(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // SIFT_BYTES, 8), np.uint8)
    out[:, :SIFT_BYTES] = x.reshape(-1, SIFT_BYTES)
    return out.view("<u8").ravel()


class PerfectHash:
    """A slot from 0 on for each distinct key of three words, none left over; keys are stored by slot and verified, if kept.

    Level by level, keys that are alone at their place get it, the others go to the next level; ranks are running bit counts.
    Keys are placed by a 64-bit hash under the first seed that gives no two of them the same.
    """

    def __init__(self, keys: np.ndarray, load: float = 2.0, seeds: int = 4, kept: bool = True) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.n, self.keys = len(keys), np.zeros((len(keys) if kept else 0, 3), U)
        keys = keys.astype(U)
        for self.seed in range(1, seeds + 1):
            hashes = mix(keys[:, 0], keys[:, 1], keys[:, 2], self.seed)
            if len(np.unique(hashes)) == len(keys):
                break
        else:
            raise ValueError("keys of a perfect hash must be distinct")
        left, done = np.arange(len(keys)), 0
        while len(left):
            size = max(64, int(load * len(left)))
            place = self._place(hashes[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(-(-size // 64), U)
            np.bitwise_or.at(bits, place[alone] >> 6, U(1) << (place[alone] & 63).astype(U))
            rank = done + np.concatenate([[0], np.cumsum(np.bitwise_count(bits))[:-1]]).astype(np.int64)
            self.levels.append((size, bits, rank))
            if kept:
                self.keys[self._slot(bits, rank, place[alone])] = keys[left[alone]]
            done += int(alone.sum())
            left = left[~alone]

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (hashes ^ (U(level + 1) * _M[1])) * _M[2]
            return ((x ^ (x >> U(32))) % np.asarray(size, U)).astype(np.int64)

    @staticmethod
    def _slot(bits: np.ndarray, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        return rank[word] + np.bitwise_count(bits[word] & ((U(1) << (place & 63).astype(U)) - U(1)))

    def __len__(self) -> int:
        return self.n

    def slots(self, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not stored."""
        out = np.full(len(h1), -1, np.int64)
        todo, hashes = np.arange(len(h1)), mix(h1, h2, h3, self.seed)
        for level, (size, bits, rank) in enumerate(self.levels):
            if not len(todo):
                break
            place = self._place(hashes[todo], level, size)
            there = (bits[place >> 6] >> (place & 63).astype(U)) & U(1) == 1
            at = todo[there]
            out[at] = self._slot(bits, rank, place[there])
            todo = todo[~there]
        at = np.flatnonzero(out >= 0)
        held = self.keys[out[at]]
        out[at[(held[:, 0] != h1[at]) | (held[:, 1] != h2[at]) | (held[:, 2] != h3[at])]] = -1
        return out


class PartedHash:
    """Perfect hashes without keys of the parts of all keys, told apart by the highest bits of ``slice_of``; slots go on from part to part.

    The levels of all parts lie behind one another, so that a lookup costs the same for any number of parts.
    """

    def __init__(self, parts: dict[int, PerfectHash], log_parts: int) -> None:
        deep = max((len(x.levels) for x in parts.values()), default=0)
        self.log, self.n, at = log_parts, 0, 1
        self.seeds = np.ones(1 << log_parts, np.uint8)
        # a level that a part lacks is the first word, which has no bit
        self.sizes, self.starts = np.ones((deep, 1 << log_parts), U), np.zeros((deep, 1 << log_parts), np.int64)
        bits, ranks = [np.zeros(1, U)], [np.zeros(1, np.int64)]
        for k, x in sorted(parts.items()):
            self.seeds[k] = x.seed
            for level, (size, b, rank) in enumerate(x.levels):
                self.sizes[level, k], self.starts[level, k], at = size, at, at + len(b)
                bits.append(b)
                ranks.append(rank + self.n)
            self.n += len(x)
        self.bits, self.ranks = np.concatenate(bits), np.concatenate(ranks)

    def __len__(self) -> int:
        return self.n

    def slots(self, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The slot of each key, whose ``slice_of`` is told; other keys than those of the table get any slot or -1."""
        part, hashes = (place >> U(SLICE_BITS - self.log)).astype(np.int64), mix(h1, h2, h3, 1)
        for seed in set(self.seeds.tolist()) - {1}:
            own = np.flatnonzero(self.seeds[part] == seed)
            hashes[own] = mix(h1[own], h2[own], h3[own], seed)
        out, todo = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level in range(len(self.sizes)):
            if not len(todo):
                break
            p = part[todo]
            at = PerfectHash._place(hashes[todo], level, self.sizes[level][p])
            at += self.starts[level][p] << 6
            there = (self.bits[at >> 6] >> (at & 63).astype(U)) & U(1) == 1
            out[todo[there]] = PerfectHash._slot(self.bits, self.ranks, at[there])
            todo = todo[~there]
        return out


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The perfect hash of each part that came to this task."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        part, keys = batch.column("part").to_numpy(), np.stack([batch.column(c).to_numpy().view(U) for c in KEY], 1)
        for k in np.unique(part).tolist():
            held.setdefault(k, []).append(keys[part == k])
    while held:
        part, keys = held.popitem()
        keys = np.concatenate(keys)
        table = pickle.dumps(PerfectHash(keys[np.lexsort(keys.T)], 2.0, 4, False), pickle.HIGHEST_PROTOCOL)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([table], pa.binary())], ["part", "hash"])


def perfect_hash(candidates: DataFrame, own: int, slices: int, n: int) -> PartedHash:
    """Of the keys of one slice, some n in number; each part is built by a task, and the driver never holds their keys apart from that."""
    log_parts = max(0, math.ceil(math.log2(max(1, n) / PART_KEYS)))
    mine = candidates.where(F.col("at") % slices == own)
    parts = mine.select(*KEY, F.shiftright("at", SLICE_BITS - log_parts).cast("int").alias("part")).repartition(1 << log_parts, "part")
    got = parts.mapInArrow(_built, "part int, hash binary").toArrow()
    return PartedHash({k.as_py(): pickle.loads(x.as_buffer()) for k, x in zip(got.column("part"), got.column("hash"), strict=True)}, log_parts)


# -- texts to hashes


class _Codes(dict):
    """A number for each word of a chunk as it comes."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _hash(lang: bytes, word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang + b"\n" + word, seed)


def _code(lang: bytes) -> int:
    """A lang as a signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(lang) - (1 << 63)


class _Chunk:
    def __init__(self, lang: str) -> None:
        self.lang, self.codes, self.parts, self.n = lang, _Codes({b"\n": 0, b"": 1}), [], 0

    def add(self, text: bytes) -> None:
        text, start = text.translate(_PLAIN).replace(b"\n", b" \n ") + b" \n", 0
        while start < len(text):  # a long text in steps that end at blanks: word objects take many times its bytes
            end = text.find(b" ", start + STEP) if start + STEP < len(text) else -1
            tokens = text[start : end if end >= 0 else len(text)].split(b" ")
            codes = np.fromiter(map(self.codes.__getitem__, tokens), np.int32, len(tokens))
            self.parts.append(codes[codes != 1])
            self.n += len(self.parts[-1])
            start = end + 1 if end >= 0 else len(text)

    def row(self, seed: int, bits: int) -> tuple:
        codes, words, lang = np.concatenate(self.parts), list(self.codes)[2:], self.lang.encode()
        hashes = np.array([(_hash(lang, w, seed) >> (64 - bits)) or 1 for w in words], U)
        counts = np.bincount(codes, minlength=len(hashes) + 2)[2:].astype("<u4")
        return self.lang, _code(lang), _placed(codes), b"\n".join(words), hashes.tobytes(), counts.tobytes(), int(counts.sum())


def _placed(codes: np.ndarray) -> bytes:
    """Ends of pieces as 0 and words as numbers from 1 on: the lowest bytes of all, then the second ones and so on, which packs well."""
    return np.ascontiguousarray(np.maximum(codes - 1, 0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _in_order(places: pa.Scalar, hashes: pa.Scalar) -> np.ndarray:
    """The hashes of a chunk's words in order, zero at the end of a piece."""
    at = np.ascontiguousarray(np.frombuffer(places.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.concatenate([np.zeros(1, U), np.frombuffer(hashes.as_buffer(), U)])[at]


def _hashed(seed: int, bits: int):
    def rows(chunks) -> pa.RecordBatch:
        names = [x.split()[0] for x in WORDS.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(chunks.row(seed, bits), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Chunk] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                if lang not in open_:
                    open_[lang] = _Chunk(lang)
                chunk = open_[lang]
                chunk.add(text.as_py())
                if chunk.n >= CHUNK or len(open_) > 64:
                    yield rows(open_.pop(lang))
        for chunk in open_.values():
            yield rows(chunk)

    return run


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sliced(hashes: np.ndarray, log_slices: int, bits: int = 64) -> list[tuple[int, slice]]:
    """Where each slice, the highest bits of a hash, lies in sorted hashes."""
    ends = np.searchsorted(hashes >> U(bits - log_slices), np.arange(1 << log_slices, dtype=U), side="right").tolist()
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]


def _packed(parts: list[tuple[int, slice]], **arrays: np.ndarray) -> pa.RecordBatch:
    """A row for each slice with the bytes of its share of the arrays."""
    columns = [pa.array([np.ascontiguousarray(x[at]).tobytes() for _, at in parts], pa.binary()) for x in arrays.values()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), *columns], ["slice", *arrays])


def _gathered(batches: Iterator[pa.RecordBatch], *kinds: str) -> Iterator[list[np.ndarray]]:
    """The arrays of each slice, put together."""
    held: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        for k, *parts in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            for at, part in zip(held.setdefault(k, [[] for _ in kinds]), parts, strict=True):
                at.append(part)
    while held:
        yield [np.frombuffer(b"".join(x), kind) for x, kind in zip(held.popitem()[1], kinds, strict=True)]


def _word_counts(log_slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, code, words, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "code", "words", "word_hashes", "counts")), strict=True):
                h = np.frombuffer(hashes, U)
                told = np.array([_hash(lang.encode(), w, 1 << 32) & 0xFFFFFFFF for w in words.split(b"\n")] if len(h) else [], "<u4")
                order = np.argsort(h)
                h = h[order]
                yield _packed(_sliced(h, log_slices), h=h, told=told[order], counts=np.frombuffer(counts, "<u4")[order], code=np.full(len(h), code, np.int64))

    return run


def _frequent(least: int):
    """Frequent words, and those that share a hash: meets says which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, told, counts, code in _gathered(batches, "<u8", "<u4", "<u4", "<i8"):
            order = np.lexsort((told, h))
            h, told, code = h[order], told[order], code[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            total, last = np.add.reduceat(counts[order].astype(np.int64), first), np.concatenate([first[1:], [len(h)]]) - 1
            meets = told[first] != told[last]
            kept = (total >= least) | meets
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[first][kept]), _as_long(h[first][kept]), pa.array(meets[kept]), _as_long(slice_of(h[first][kept], U(0), U(0))), pa.array(total[kept])],
                ["code", "h", "meets", "at", "total"],
            )

    return run


# -- candidates


class Bitmap:
    """Which hashes are in a set, by four bits of one word that their lowest bits choose; says yes to all of the set, and to some others."""

    def __init__(self, hashes: DataFrame, column: str) -> None:
        self.log = min(MOST_BITS, max(12, math.ceil(math.log2(SPARSE * hashes.count() + 1))))
        piece = min(self.log, PIECE_BITS)
        places = hashes.select(F.col(column).bitwiseAND((1 << (self.log + 18)) - 1).alias("p"))
        dealt = places.repartition(F.shiftright(F.col("p").bitwiseAND((1 << self.log) - 1), piece))
        got = dealt.mapInArrow(_pieces(self.log, piece), "piece int, bits binary").toArrow()  # at most 2^(log - 3) bytes
        self.bits = np.zeros((1 << (self.log - piece), 1 << (piece - 6)), U)
        for k, x in zip(got.column("piece"), got.column("bits"), strict=True):
            self.bits[k.as_py()] = np.frombuffer(x.as_buffer(), U)
        self.bits = self.bits.ravel()

    def has(self, x: np.ndarray) -> np.ndarray:
        chosen = _four_bits(x, self.log)
        return self.bits[((x & U((1 << self.log) - 1)) >> U(6)).astype(np.int64)] & chosen == chosen


def _four_bits(x: np.ndarray, log: int) -> np.ndarray:
    """The bits of its word that a hash has in a bitmap: by its lowest six bits, and three times six from the log-th on."""
    out = U(1) << (x & U(63))
    for k in range(3):
        out |= U(1) << ((x >> U(log + 6 * k)) & U(63))
    return out


def _pieces(log: int, piece: int):
    """The pieces of a bitmap whose places came to this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).to_numpy().view(U)
            p = (x & U((1 << log) - 1)).astype(np.int64)
            for k in np.unique(p >> piece).tolist():
                own = p >> piece == k
                bits = held.setdefault(k, np.zeros(1 << (piece - 6), U))
                np.bitwise_or.at(bits, (p[own] - (k << piece)) >> 6, _four_bits(x[own], log))
        for k, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["piece", "bits"])

    return run


def _grams(h: np.ndarray, filters: list[Bitmap]) -> list[np.ndarray]:
    """Places of words, pairs and triples that the filters let pass, for as many lengths as there are filters, and one more."""
    good = np.zeros(len(h) + 2, bool)
    good[: len(h)] = (h != 0) & filters[0].has(h)
    out = [np.flatnonzero(good)]
    pair = good[:-2] & good[1:-1]
    at = np.flatnonzero(pair)
    if len(filters) > 1:
        at = at[filters[1].has(sift_hash(h[at], h[at + 1], None))]
    out.append(at)
    if len(filters) > 1:
        passed = np.zeros(len(h) + 1, bool)
        passed[at] = True
        at = np.flatnonzero(passed[:-1] & passed[1:])
        if len(filters) > 2:
            at = at[filters[2].has(sift_hash(h[at], h[at + 1], h[at + 2]))]
        out.append(at)
    return out


def _routed(shared, log_slices: int):
    """Occurrences of the next length to slices of their hashes, each chunk's equal ones as one with a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [x.value for x in shared]
        for batch in batches:
            for places, hashes in zip(batch.column("places"), batch.column("word_hashes"), strict=True):
                h = _in_order(places, hashes)
                at = _grams(h, filters)[-1]
                m, n = np.unique(sift_hash(h[at], h[at + 1], h[at + 2] if len(filters) > 1 else None), return_counts=True)
                yield _packed(_sliced(m, log_slices, 8 * SIFT_BYTES), hashes=_narrow(m), counts=n.astype("<u4"))

    return run


def _sifted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, n in _gathered(batches, "u1", "<u4"):
            hashes, at = np.unique(_widen(m), return_inverse=True)
            yield pa.RecordBatch.from_arrays([_as_long(hashes[np.bincount(at, n) >= least])], ["m"])

    return run


def _unique(keys: np.ndarray) -> np.ndarray:
    keys = keys[np.lexsort(keys.T)]
    return keys[np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])[: len(keys)]]


SLICE_BITS = 31


def slice_of(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> np.ndarray:
    """31 bits: the remainder says to which slice of the candidates a key goes, the highest ones to which part of it, whatever their number."""
    return mix(h1, h2, h3, 99) & U((1 << SLICE_BITS) - 1)


def _found(shared, log_slices: int):
    """Distinct keys of the pairs and triples of a task that the filters let pass, with the code of their lang, to slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, filters = [], 0, [x.value for x in shared]

        def packed() -> pa.RecordBatch:
            keys = _unique(np.concatenate(held))
            hashes = mix(keys[:, 1], keys[:, 2], keys[:, 3])
            order = np.argsort(hashes)
            return _packed(_sliced(hashes[order], log_slices), **{c: keys[order, i] for i, c in enumerate(["code", *KEY])})

        for batch in batches:
            for code, places, hashes in zip(batch.column("code").to_numpy(), batch.column("places"), batch.column("word_hashes"), strict=True):
                h = _in_order(places, hashes)
                _, pairs, triples = _grams(h, filters)
                keys = _unique(np.concatenate([_keys(h, pairs, 2), _keys(h, triples, 3)]))
                held.append(np.concatenate([np.full((len(keys), 1), code).view(U), keys], 1))
                n += len(keys)
                if n >= HELD:
                    yield packed()
                    held, n = [], 0
        if n:
            yield packed()

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns in _gathered(batches, *["<u8"] * 4):
        keys = _unique(np.stack(columns, 1))
        at = slice_of(keys[:, 1], keys[:, 2], keys[:, 3])
        yield pa.RecordBatch.from_arrays([*(_as_long(keys[:, i]) for i in range(4)), _as_long(at)], ["code", *KEY, "at"])


def _keys(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(at), 3), U)
    for i in range(k):
        out[:, i] = h[at + i]
    return out


# -- counts by slot


COUNTS = "part int, task int, places binary, counts binary"


def _counted(shared, slots, own: int, slices: int):
    """Occurrences by slot of the pairs and triples of one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: PartedHash = slots.value
        counts, added, filters = np.zeros(len(table), np.uint32), 0, [x.value for x in shared]

        def add(*key: np.ndarray) -> None:
            place = slice_of(*key)
            mine = np.flatnonzero(place % U(slices) == U(own))
            at = table.slots(*(k[mine] for k in key), place[mine])
            if (at < 0).any():
                raise ValueError("a phrase that the bitmaps let pass is no candidate")
            np.add.at(counts, at, np.uint32(1))

        for batch in batches:
            for places, words in zip(batch.column("places"), batch.column("word_hashes"), strict=True):
                h = _in_order(places, words)
                _, pairs, triples = _grams(h, filters)
                if added + len(pairs) + len(triples) >= 1 << 32:
                    yield _count_rows(np.arange(len(counts)), counts)
                    counts[:], added = 0, 0
                add(h[pairs], h[pairs + 1], np.zeros(len(pairs), U))
                add(h[triples], h[triples + 1], h[triples + 2])
                added += len(pairs) + len(triples)
        yield _count_rows(np.arange(len(counts)), counts)

    return run


def _words_counted(slots):
    """The counts of words, which are known, by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, place = (batch.column(c).to_numpy().view(U) for c in ("h", "at"))
            none = np.zeros(len(h), U)
            at = slots.value.slots(h, none, none, place)
            order = np.argsort(at)
            yield _count_rows(at[order], batch.column("total").to_numpy()[order])

    return run


def _count_rows(at: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each ROW_SLOTS slots that have counts: which of them, in order, and how many, in as few bytes as hold them."""
    at, counts = at[counts > 0], counts[counts > 0]
    parts, first = np.unique(at // ROW_SLOTS, return_index=True)
    places, each = [], []
    for a, b in zip(first.tolist(), [*first.tolist()[1:], len(at)], strict=False):
        places.append((at[a:b] % ROW_SLOTS).astype("<u2").tobytes())
        each.append(counts[a:b].astype(np.min_scalar_type(int(counts[a:b].max()))).tobytes())
    task = pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), task, pa.array(places, pa.binary()), pa.array(each, pa.binary())], ["part", "task", "places", "counts"])


def _of_row(places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(places, "<u2")
    return at, np.frombuffer(counts, f"<u{len(counts) // max(1, len(at))}").astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "places", "counts")), strict=True):
            at, n = _of_row(*row)
            total.setdefault(part, np.zeros(ROW_SLOTS, np.int64))[at] += n
    for part, counts in total.items():
        yield _count_rows(part * ROW_SLOTS + np.arange(ROW_SLOTS), counts)


def _slot_counts(words: DataFrame, frequent: DataFrame, filters, slots, n: int, own: int, slices: int) -> np.ndarray:
    """Counts by slot: arrays of tasks are summed by groups of tasks, then all."""
    rows = words.select("places", "word_hashes").mapInArrow(_counted(filters, slots, own, slices), COUNTS)
    tasks = max(1, rows.rdd.getNumPartitions())
    groups = math.isqrt(tasks - 1) + 1
    parts = -(-n // ROW_SLOTS)
    rows = rows.union(frequent.where(F.col("at") % slices == own).select("h", "at", "total").mapInArrow(_words_counted(slots), COUNTS))
    some = rows.withColumn("task", F.col("task") % groups).repartition(min(parts * groups, tasks), "part", "task").mapInArrow(_summed, COUNTS)
    got = some.repartition(parts, "part").mapInArrow(_summed, COUNTS).select("part", "places", "counts").collect()
    out = np.zeros(n, np.int64)
    for r in got:
        at, counts = _of_row(r.places, r.counts)
        out[r.part * ROW_SLOTS + at.astype(np.int64)] = counts
    return out.astype(np.min_scalar_type(int(out.max(initial=0))))


#: What is read for a phrase: its own frequency, and those of both parts at each cut.
READ = ["a", "l1", "r1", "l2", "r2"]


def _read(slots, counts, own: int, slices: int):
    """Fill in what the slots of this slice know. Parts that are no candidates are words of phrases that are too rare to be scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count = slots.value, counts.value
        for batch in batches:
            h1, h2, h3 = (batch.column(c).to_numpy().view(U) for c in KEY)
            zero = np.zeros(len(h1), U)
            # a pair has no second cut: its key there would be that of the pair, or none
            sought = {"a": (h1, h2, h3), "l1": (h1, zero, zero), "r1": (h2, h3, zero), "l2": (h1, h2, zero), "r2": (h3, zero, zero)}
            got = []
            for name in READ:
                known = batch.column(name).to_numpy(zero_copy_only=False).copy()
                place = slice_of(*sought[name])
                mine = np.flatnonzero(place % U(slices) == U(own))
                at = table.slots(*(x[mine] for x in sought[name]), place[mine])
                known[mine[at >= 0]] = count[at[at >= 0]]
                got.append(pa.array(known))
            yield pa.RecordBatch.from_arrays([batch.column("code"), *(batch.column(c) for c in KEY), *got], ["code", *KEY, *READ])

    return run


def _scored(least: int, scale: int):
    """Frequent phrases with the cut that scores lowest, in whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(batch.column("a").to_numpy() >= least))
            best = []
            for three, a, l1, r1, l2, r2 in zip((batch.column("h3").to_numpy() != 0).tolist(), *(batch.column(c).to_pylist() for c in READ), strict=True):
                cuts = [(scale * a * a // (l1 * r1), 1, l1, r1)]
                if three:
                    cuts.append((scale * a * a // (l2 * r2), 2, l2, r2))
                best.append(min(cuts))
            columns = [pa.array([b[i] for b in best], pa.int64()) for i in (2, 3, 0)]
            yield pa.RecordBatch.from_arrays([batch.column("code"), *(batch.column(c) for c in KEY), batch.column("a"), *columns], ["code", *KEY, "a", "l", "r", "score"])

    return run


def _named(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, raw in zip(batch.column("words").to_pylist(), batch.column("word_hashes").to_pylist(), strict=True):
                h = np.frombuffer(raw, U)
                at = np.flatnonzero(wanted.value.has(h))
                each = words.split(b"\n") if len(at) else []
                yield pa.RecordBatch.from_arrays([_as_long(h[at]), pa.array([each[i].decode() for i in at], pa.string())], ["h", "word"])

    return run


def _hash_words(texts: DataFrame, scratch: Scratch, least: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(the table of chunks, the frequent words as code, h, their slice and count, the words of each lang, binary logarithm of the number of slices), with
    a seed under which no two words share a hash."""
    for seed in range(SEEDS):
        words = scratch.put(scratch.fresh("words"), texts.mapInArrow(_hashed(seed, bits), WORDS), **WIDE_ROWS)
        totals = words.groupBy("code").agg(F.sum("n").alias("n"), F.max("lang").alias("lang"))
        log_slices = max(4, math.ceil(math.log2(max(1, totals.agg(F.sum("n")).first()[0] or 0) / SIFTED)))
        each = words.select("lang", "code", "words", "word_hashes", "counts").mapInArrow(_word_counts(log_slices), "slice int, h binary, told binary, counts binary, code binary")
        known = each.repartition(1 << log_slices, "slice").mapInArrow(_frequent(least), "code long, h long, meets boolean, at long, total long")
        known = scratch.put(scratch.fresh("known"), known)
        if not known.where("meets").limit(1).count():
            return words, known.drop("meets"), totals, log_slices
        scratch.drop(*scratch.made[-2:])
    raise ValueError(f"two words share a hash of {bits} bits under each of {SEEDS} seeds")


def collocations(
    docs: DataFrame, least: int = 10, top: int = 2000, scale: int = 1_000_000, inside: int = 50, slice_keys: int = 1 << 23, bits: int = 64
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each lang's first ``top`` phrases of two and three words.

    inside: a phrase goes if a longer candidate holds it with that share, in hundredths, of its frequency at least.
    bits: of a word's hash; two words of one hash cost another pass over the texts.
    """
    spark: SparkSession = docs.sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark)
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    texts = keep_only(docs, lang="string", text="string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    with shuffles_released(spark):
        words, frequent, totals, log_slices = _hash_words(texts, scratch, least, bits)
        totals = scratch.put("totals", totals)
        shared = [sc.broadcast(Bitmap(frequent, "h"))]
        for _ in range(2):
            routed = words.select("places", "word_hashes").mapInArrow(_routed(shared, log_slices), "slice int, hashes binary, counts binary")
            passed = routed.repartition(1 << log_slices, "slice").mapInArrow(_sifted(least), "m long")
            shared = [*shared, sc.broadcast(Bitmap(scratch.put(scratch.fresh("passed"), passed), "m"))]
            scratch.drop(scratch.made[-1])
        found = words.select("code", "places", "word_hashes").mapInArrow(_found(shared, log_slices), "slice int, code binary, h1 binary, h2 binary, h3 binary")
        phrases = found.repartition(1 << log_slices, "slice").mapInArrow(_distinct, "code long, h1 long, h2 long, h3 long, at long")
        none = F.lit(0).cast("long")
        single = frequent.select("code", F.col("h").alias("h1"), none.alias("h2"), none.alias("h3"), "at")
        candidates = scratch.put("candidates", phrases.union(single))
        n = candidates.count()
        slices = max(1, -(-n // slice_keys))
        scored = candidates.where("h2 <> 0").select("code", *KEY, *[none.alias(c) for c in READ])
        for k in range(slices):
            table = perfect_hash(candidates, k, slices, n // slices)
            size, slots = len(table), sc.broadcast(table)
            del table
            counts = sc.broadcast(_slot_counts(words, frequent, shared, slots, size, k, slices) if size else np.zeros(0, np.int64))
            scored = scored.mapInArrow(_read(slots, counts, k, slices), scored.schema)
            if k < slices - 1:
                scored = scratch.put(scratch.fresh("read"), scored)
            else:
                scored = scratch.put("scored", scored.mapInArrow(_scored(least, scale), "code long, h1 long, h2 long, h3 long, a long, l long, r long, score long"))
            slots.destroy()  # else the driver holds the tables of all slices until it collects garbage
            counts.destroy()
        for x in shared:
            x.destroy()
        scratch.drop("candidates", *[x for x in scratch.made if x.startswith("read")])
        first = scratch.put("first", _first(scored, top, inside))
        wanted = first.select(F.explode(F.array(*KEY)).alias("h")).where("h <> 0").distinct()
        sought = sc.broadcast(Bitmap(wanted, "h"))
        names = scratch.put("names", words.select("words", "word_hashes").mapInArrow(_named(sought), "h long, word string").distinct())
        sought.destroy()
        scratch.drop("scored", *[x for x in scratch.made if x.startswith("words")])
    each = first.select("*", F.posexplode(F.array(*KEY)).alias("i", "h")).where("h <> 0")
    joined = each.join(names, "h").groupBy("code", *KEY, "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    phrase = joined.withColumn("phrase", F.array_join(F.col("w.word"), " ")).join(totals, "code")
    order = Window.partitionBy("code").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = phrase.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in schema.split(", ")])


def _first(scored: DataFrame, top: int, inside: int) -> DataFrame:
    """Phrases that no longer one holds often enough, of each lang those that may be among its first ``top``."""
    triples = scored.where("h3 <> 0")
    longer = triples.select("h1", "h2", "a").union(triples.select("h2", "h3", "a")).toDF("h1", "h2", "m").groupBy("h1", "h2").agg(F.max("m").alias("m"))
    alone = scored.where("h3 = 0").join(longer, ["h1", "h2"], "left").where(F.col("m").isNull() | (F.col("m") * 100 < F.col("a") * inside))
    kept = alone.select(*scored.columns).union(triples)
    # a lang's scores in some hundred steps say from which on its first ones are
    step = F.floor(F.log1p("score") * 64).cast("int")
    above = Window.partitionBy("code").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = kept.groupBy("code", step.alias("step")).agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(above), F.lit(0)))
    floors = steps.where(F.col("before") < top).groupBy("code").agg(F.min("step").alias("from"))
    return kept.join(floors, "code").where(step >= F.col("from")).drop("from")
