"""Best-fit packing: a configuration linear program over the length histogram.

Pieces of one length are interchangeable, so the corpus is packed through its histogram: at most ``capacity`` counts,
whatever the number of documents. A configuration is a multiset of lengths that fits a sequence. The program asks for
the fewest sequences that cover all counts; multiplicative weights solve it: lengths that are covered less than others
get higher prices, a knapsack dynamic program finds the configuration of the highest price, and that configuration is
used a little more. The solution is rounded down to whole sequences, and what is left over is packed best-fit
decreasing, again by length. Pieces then look up their place by their number within their length, on the executors.

Null and empty texts are the end id alone. A document longer than a sequence is cut into full pieces, its first piece
takes what is over. Repeated ids and rows are packed as they come. An empty table gives an empty result. Columns other than
doc_id and text are not read, names that differ from these in case alone included.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_only, numbered

#: Pieces in a batch that leaves a task.
CHUNK = 5_000
#: Rounds of multiplicative weights; each costs one dynamic program over the capacity.
ROUNDS = 1_200

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task numbers, at most about; a length gets as many buckets as that asks for.
BUCKET_ROWS = 2_000


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of texts under a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    The file's merges rank as its ids do, so the ranks are read from its vocabulary and texts are encoded by the faster
    of the two libraries that implement this BPE; the tests hold the ids against the tokenizers library's own. Strings of
    added tokens in a text have their ids, as in that library's default.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, special = _byte_of(), {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        return self.bpe.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def _piece_rows(path: str, capacity: int, end_id: int, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                packed = encoder.encode(text or "") + end
                n = len(packed) // 4
                first = n if n <= capacity else n % capacity or capacity
                starts = [0, *range(first, n, capacity), n]
                for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
                    piece = packed[4 * a : 4 * b]
                    out.append((doc_id, k, a, b - a, zlib.crc32(piece), *([piece] if with_ids else [])))
                if len(out) > CHUNK:
                    yield _pieces(out, with_ids)
                    out = []
            if out:
                yield _pieces(out, with_ids)

    return rows


def _pieces(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names)


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> dict[int, int]:
    """Copies of each length, by index, that fit the capacity at the highest total price."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            value = price[:k] + best[c - lengths[:k]]
            i = int(value.argmax())
            if value[i] > best[c]:
                best[c], took[c] = value[i], i
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[int(took[c])] = out.get(int(took[c]), 0) + 1
            c -= int(lengths[took[c]])
    return out


def solve(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration as copies of each length, sequences of it): together they hold exactly ``counts``."""
    done: list[tuple[dict[int, int], int]] = []
    if counts.get(capacity):
        done.append(({capacity: 1}, counts[capacity]))
    lengths = np.array(sorted(k for k, n in counts.items() if n > 0 and k < capacity), np.int64)
    if not len(lengths):
        return done
    need = np.array([counts[int(k)] for k in lengths], float)
    covered, used = np.zeros(len(lengths)), {}
    for _ in range(rounds if len(lengths) > 1 else 0):
        share = covered / need
        low = share.min()
        if low >= 1:
            break
        # sizes are the price where all are covered alike: a full sequence is then the best
        price = lengths * np.exp(-4.0 * (share - low))
        taken = knapsack(lengths, price / price.max(), capacity)
        at, copies = np.fromiter(taken, np.int64), np.fromiter(taken.values(), float)
        step = float((0.25 * need[at] / copies).min())
        key = tuple(sorted(taken.items()))
        used[key] = used.get(key, 0.0) + step
        covered[at] += step * copies
    left = need.astype(np.int64)
    scale = 1.0 / max(1.0, float((covered / need).mean())) if used else 1.0
    for key, x in sorted(used.items(), key=lambda kv: (-kv[1], kv[0])):
        n = min(int(x * scale), *(int(left[i] // k) for i, k in key))
        if n > 0:
            done.append(({int(lengths[i]): k for i, k in key}, n))
            for i, k in key:
                left[i] -= n * k
    return done + best_fit({int(k): int(n) for k, n in zip(lengths, left, strict=True) if n}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing by length: the longest piece left, then always the longest that still fits."""
    out, lengths, left = [], sorted(counts), dict(counts)
    while lengths:
        taken, room = {}, capacity
        while room and (i := bisect_right(lengths, room)):
            while i and not left[lengths[i - 1]] - taken.get(lengths[i - 1], 0):
                i -= 1
            if not i:
                break
            k = lengths[i - 1]
            n = min(left[k] - taken.get(k, 0), room // k)
            taken[k] = taken.get(k, 0) + n
            room -= n * k
        times = min(left[k] // n for k, n in taken.items())
        out.append((taken, times))
        for k, n in taken.items():
            left[k] -= n * times
            if not left[k]:
                lengths.remove(k)
    return out


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, list[np.ndarray]]:
    """For each length: first number, copies in a sequence, first sequence and offset of each configuration that has it."""
    rows: dict[int, list[tuple]] = {}
    upto: dict[int, int] = {}
    sequence = 0
    for taken, times in plan:
        offset = 0
        for k, n in sorted(taken.items(), reverse=True):
            rows.setdefault(k, []).append((upto.get(k, 0), n, sequence, offset))
            upto[k] = upto.get(k, 0) + n * times
            offset += k * n
        sequence += times
    return {k: [np.array(c, np.int64) for c in zip(*v, strict=True)] for k, v in rows.items()}


def _placer(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                first, copies, base, off = shared.value[k]
                i = np.searchsorted(first, rank[at], side="right") - 1
                n = rank[at] - first[i]
                sequence[at], offset[at] = base[i] + n // copies[i], off[i] + n % copies[i] * k
            keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)],
                [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    return place


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with_ids: also its ids, as little-endian unsigned 32-bit bytes."""
    named = keep_only(docs, doc_id="long", text="string")
    return named.mapInArrow(
        _piece_rows(tokenizer, capacity, end_id, with_ids), PIECES + (", ids binary" if with_ids else "")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    made = cut(pieces(docs, tokenizer, capacity, end_id, with_ids))
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    shared = made.sparkSession.sparkContext.broadcast(_places(solve(counts, capacity)))
    # pieces of one length are interchangeable, so any number will do: a row's own, whatever its id and whoever shares it
    dealt = made.withColumn("_row", F.monotonically_increasing_id())
    many = F.create_map(*[F.lit(int(x)) for k, n in sorted(counts.items()) for x in (k, -(-n // BUCKET_ROWS))]) if counts else F.lit(None)
    ranked = numbered(dealt, "length", "_row", "rank", F.element_at(many, F.col("length").cast("int")) if counts else F.lit(1))
    schema = PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    columns = [x.split()[0] for x in PIECES.split(", ")] + (["ids"] if with_ids else [])
    return ranked.select(*columns, "rank").mapInArrow(_placer(shared), schema)
