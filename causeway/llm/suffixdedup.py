"""Removal of repeated passages: sparse suffixes by distributed prefix doubling, then an exact test.

Every byte covered by a ``width``-byte string that also starts elsewhere goes. Ranking the suffix at every byte costs many
times the corpus, so positions are thinned first, by content alone: of each window of 8-byte grams the one with the least
hash is an anchor, and a start belongs to the anchor of its first window. Two equal strings have the same anchors at the
same offsets, and between the first and the last of them the same phrases, so nothing is lost.

Doubling: an anchor's first rank is its phrase, the text up to the next anchor. The ranks of 2^j phrases at positions i
and i + 2^j make a pair; Spark brings equal pairs together, each gets one rank of 2^(j+1) phrases, and positions whose
rank is unique leave. An anchor is past the threshold with the largest power of two of phrases that surely lie in every
string it serves; its rank at that length, with a digest of the bytes from there to the end of what all its strings share,
is the anchor's core. The result is decided on cores, and so on the ranks.

Exact test: an anchor whose core is unique serves no repeated string. The others have a span, the bytes of all strings
they serve: anchors whose span repeats are covered as a whole, and for the few in between, and the distinct spans they
could match, the strings are compared one start at a time.

Repeats too short to go are told: n_shared is the number of bytes in pieces of PIECE bytes, one from each anchor on,
that also stand elsewhere. A repeated passage of ``window + PIECE`` bytes has such a piece, one under PIECE has none.

Ranks are 64-bit hashes and only ever meet under a second 64-bit digest of other bytes; texts are told apart by 128 bits.
Counts are partial sums (a passage of a third of all documents is one row for each map task), and the joins that follow
can be split. Copies of a text are one class: their rows fall together before anything is compared, and a class of two or
more texts goes whole.

Null texts are empty. Texts under ``width`` bytes lose nothing. Repeated doc_ids and equal rows are documents of their
own: equal texts remove each other. Null ids stay. Empty tables give empty results; columns other than doc_id and text
are not read, names that differ from these in case alone included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, keep_only, shuffles_released

GRAM = 8
#: Bytes of a text that are looked at in one step.
STEP = 1 << 20
#: Bits of a sieve for each key in it, and at most. A sieve lets a few others pass, so it only spares work.
BITS_PER_KEY, MOST_BITS = 16, 1 << 28
#: Bytes of a piece that is told but not removed.
PIECE = 128
_MIX = np.uint64(0x9E3779B97F4A7C15)
TEXT = ["ch", "cx"]


def window_of(width: int) -> int:
    """Grams in a window: a wide one thins more, a narrow one leaves more of a string between its outer anchors."""
    return max(4, (width - GRAM) * 3 // 8)


def _slid(x: np.ndarray, window: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each ``window`` neighbours, by doubling."""
    run = 1
    while 2 * run <= window:
        x = least(x[:-run], x[run:])
        run *= 2
    return least(x[: len(x) - (window - run)], x[window - run :]) if run < window else x


def anchors(text: bytes, window: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions of anchors, first start each serves), both rising; starts are served up to the next one's first.

    A gram is an anchor if it has the least hash of some window; of equal hashes the leftmost serves. ``ends``: where the
    texts end that ``text`` is made of; no window crosses them.
    """
    ends = np.array([len(text)]) if ends is None else ends
    grams = len(text) - GRAM + 1
    edges = (ends[:-1, None] - np.arange(1, GRAM)).ravel()
    places, keys = [], []
    for at in range(0, max(0, grams - window + 1), STEP):
        # windows that start in this step; those of the step before hold the same grams at its edge
        low = max(0, at - window)
        size = min(at + STEP + window, grams) - low
        key = (np.ndarray((size,), "<u8", text, low, (1,)) * _MIX >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        key[edges[(edges >= low) & (edges < low + size)] - low] = 0
        least = _slid(key, window, np.minimum)
        # the greatest of the minima of all windows that hold a gram; windows across an end have 0
        edge = np.zeros(window - 1, np.uint32)
        best = _slid(np.concatenate([edge, least, edge]), window, np.maximum)
        found = np.flatnonzero((best == key) & (key > 0))
        last = at + STEP >= grams - window + 1
        keep = (found + low >= at) & (last | (found + low < at + STEP))
        places.append(found[keep] + low)
        keys.append(key[found[keep]])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, key = np.concatenate(places), np.concatenate(keys)
    own = np.searchsorted(ends, place, side="right")
    begin, limit = np.concatenate([np.zeros(1, np.int64), ends[:-1]])[own], (ends - GRAM - window + 1)[own]
    before, after = _nearest(key, place, window, -1, np.less_equal), _nearest(key, place, window, 1, np.less)
    # an anchor serves from where it enters or an earlier one no worse leaves, until it leaves or a better one enters
    first = np.maximum(place - window + 1, begin)
    first = np.where(before >= 0, np.maximum(first, place[before] + 1), first)
    last = np.minimum(place, limit)
    last = np.where(after >= 0, np.minimum(last, place[after] - window), last)
    return place[first <= last], first[first <= last]


def _nearest(key: np.ndarray, place: np.ndarray, window: int, step: int, better) -> np.ndarray:
    """The index of the nearest anchor on one side, less than ``window`` away, whose key is better; -1 where there is none."""
    n = len(key)
    at = np.arange(n) + step
    at[(at < 0) | (at >= n)] = -1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        x = at[todo]
        far = np.abs(place[x] - place[todo]) >= window
        at[todo[far]] = -1
        worse = ~far & ~better(key[x], key[todo])
        # what is no better than a worse one is worse too, so its own next is the next to look at
        todo = todo[worse]
        at[todo] = at[x[worse]]
        todo = todo[at[todo] >= 0]
    return at


def _digests(text: bytes, a: list[int], b: list[int], seed: int = 0) -> np.ndarray:
    """64-bit digests of text[a:b] for each pair."""
    view, digest = memoryview(text), xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(view[x:y], seed) for x, y in zip(a, b, strict=True)]), ">i8").astype(np.int64)


KEYS = "ch long, cx long, idx long, key long"
#: A row of a piece has no r: it only says where the piece begins (first) and what it holds (name).
ANCHORS = "ch long, cx long, idx long, r long, first long, n long, name long, tail long, span long"


def _batch(out: list, schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names)


def _chunks(batch: pa.RecordBatch, least: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of at least ``least`` bytes, some together: (bytes, where each ends, ch, cx)."""
    ch, cx = (batch.column(k).to_numpy() for k in TEXT)
    held, at, size = [], [], 0
    for i, text in enumerate(batch.column("text")):
        raw = text.as_buffer()
        if raw is None or raw.size < least:
            continue
        held.append(raw)
        at.append(i)
        size += raw.size
        if size >= STEP:
            yield b"".join(held), np.cumsum([len(x) for x in held]), ch[at], cx[at]
            held, at, size = [], [], 0
    if held:
        yield b"".join(held), np.cumsum([len(x) for x in held]), ch[at], cx[at]


def _phrases(text: bytes, ends: np.ndarray, window: int):
    """place, first and text of each anchor, the last anchor of its text, and two pairs (anchors, digests): of phrases, of pieces."""
    place, first = anchors(text, window, ends)
    own = np.searchsorted(ends, place, side="right")
    final = np.searchsorted(own, own, side="right") - 1
    inner = np.flatnonzero(np.arange(len(place)) < final)
    whole = np.flatnonzero(place + PIECE <= ends[own])
    phrases = _digests(text, place[inner].tolist(), (place[inner + 1] + GRAM).tolist())
    pieces = _digests(text, place[whole].tolist(), (place[whole] + PIECE).tolist(), 3)
    return place, first, own, final, (inner, phrases), (whole, pieces)


def _key_rows(least: int, window: int):
    """The digests of all phrases and pieces."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, ends, ch, cx in _chunks(batch, least):
                _, _, own, _, *kinds = _phrases(text, ends, window)
                for at, key in kinds:
                    yield _batch([[ch[own[at]], cx[own[at]], at - np.searchsorted(own, own[at]), key]], KEYS)

    return rows


def _anchor_rows(width: int, window: int, sieve):
    """The rows of anchors whose phrase passes the sieve of repeated ones, and of pieces that do."""

    def passed(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = sieve.value
        hit = key.view(np.uint64) & np.uint64(8 * len(bits) - 1)
        ok = (bits[(hit >> np.uint64(3)).astype(np.int64)] >> (hit & np.uint64(7)).astype(np.uint8) & 1) > 0
        return at[ok], key[ok]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, ends, ch, cx in _chunks(batch, min(width, PIECE)):
                place, first, own, final, phrases, pieces = _phrases(text, ends, window)
                begin = ends - np.diff(ends, prepend=0)
                alive, name = passed(*phrases)
                doc = own[alive]
                last = np.minimum(first[alive + 1] - 1, ends[doc] - width)
                n = last - first[alive] + 1
                runs = np.searchsorted(place, place[alive] + (width - GRAM - 2 * window + 1)) - alive
                r = np.left_shift(1, np.log2(np.maximum(runs, 1)).astype(np.int64))
                # without a start, or without the phrases inside this text, an anchor only lends its ranks to others
                r[(n < 1) | (alive + runs > final[alive])] = 0
                s = np.flatnonzero(r)
                a, f = place[alive[s]], first[alive[s]]
                tail, span = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
                tail[s] = _digests(text, (place[alive[s] + r[s]] + GRAM).tolist(), (a + width - window + 1).tolist(), 1)
                span[s] = _digests(text, f.tolist(), (f + n[s] - 1 + width).tolist(), 2) ^ (a - f) * 31 ^ n[s] << 32
                idx = alive - np.searchsorted(own, doc)
                yield _batch([[ch[doc], cx[doc], idx, r, first[alive] - begin[doc], n, name, tail, span]], ANCHORS)
                at, name = passed(*pieces)
                doc, none = own[at], np.zeros(len(at), np.int64)
                yield _batch([[ch[doc], cx[doc], at - np.searchsorted(own, doc), none - 1, place[at] - begin[doc], none, name, none, none]], ANCHORS)

    return rows


PLACE = ["ch", "cx", "idx"]


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys found at two places or more, counted by partial sums."""
    place = F.xxhash64("ch", "cx", "idx")
    found = rows.groupBy(*key).agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    return found.where("_lo <> _hi").select(*key)


def repeated(rows: DataFrame, scratch: Scratch, *key: str) -> DataFrame:
    """Rows whose key is repeated.

    The keys are written first. Counted in the same job, they would stay where their hash put them and hold the rows of
    a very common key to one task; written, both sides of the join are shuffled for it and Spark can split that key.
    """
    keys = scratch.put(scratch.fresh("keys"), repeated_keys(rows, *key))
    return rows.join(keys, list(key))


def doubled(texts: DataFrame, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The anchor rows that repeat past the threshold, with their core (rank and tail in one), and repeated pieces."""
    spark, window, texts = texts.sparkSession, window_of(width), texts.select(*TEXT, "text")
    keys = texts.mapInArrow(_key_rows(min(width, PIECE), window), KEYS)
    twice = scratch.put("twice", repeated_keys(keys, "key"))
    sieve = spark.sparkContext.broadcast(bitmap(twice, "key"))
    rows = texts.mapInArrow(_anchor_rows(width, window, sieve), ANCHORS)
    # the rows of copies of a text fall together
    sifted = scratch.put("sifted", rows.dropDuplicates([*PLACE, "name"]))
    pieces = sifted.where("r < 0").join(twice.withColumnRenamed("key", "name"), "name")
    pieces = scratch.put("pieces", pieces.select(*TEXT, F.lit(True).alias("told"), F.col("first").alias("a"), (F.col("first") + PIECE).alias("b")))
    alive = sifted.where("r >= 0")
    level, run = alive.select(*PLACE, "r", "name"), 1
    done = level.where("r = 1").select(*PLACE, "name")
    while True:
        # two doublings in a round: one shuffle by text brings the ranks at i, i + run, i + 2 run and i + 3 run together
        text = Window.partitionBy(*TEXT)
        at = [F.max("name").over(text.orderBy("idx").rangeBetween(k * run, k * run)) for k in (1, 2, 3)]
        ahead = level.withColumn("deepest", F.max("r").over(text)).where(F.col("deepest") >= 2 * run)
        ahead = ahead.select(*PLACE, "r", "name", "deepest", *[x.alias(f"next{k}") for k, x in enumerate(at, 1)]).where("next1 is not null")
        pairs = scratch.put(f"pairs{run}", ahead)
        if pairs.isEmpty():
            break
        one, two = F.xxhash64("name", "next1"), F.xxhash64("next2", "next3")
        settled = scratch.put(f"settled{run}", pairs.where(F.col("r") == 2 * run).select(*PLACE, one.alias("name")))
        further = pairs.where((F.col("deepest") >= 4 * run) & F.expr("next2 is not null and next3 is not null"))
        before, run = run, 4 * run
        level = scratch.put(f"level{run}", repeated(further.select(*PLACE, "r", F.xxhash64(one, two).alias("name")), scratch, "name"))
        done = done.union(settled).union(level.where(F.col("r") == run).select(*PLACE, "name"))
        scratch.drop(f"pairs{before}")
    whole = alive.drop("name", "r").join(done, PLACE)
    out = scratch.put("repeats", whole.withColumn("core", F.xxhash64("name", "tail")).drop("name"))
    scratch.drop("twice", "sifted", *(f"{k}{1 << i}" for i in range(run.bit_length()) for k in ("pairs", "level", "settled")))
    sieve.unpersist()
    return out, pieces


def bits_for(keys: int) -> int:
    bits = 1 << 18
    while bits < min(MOST_BITS, BITS_PER_KEY * keys):
        bits *= 2
    return bits


def _parts(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The bitmap of the low bits of ``key`` in rows of 4 KB."""
    at = F.col(key).bitwiseAND(F.lit(bits - 1))
    return keys.groupBy(F.shiftright(at, 15).alias("_part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767).cast("long"))).alias("_bits"))


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """The bitmap as bytes, MOST_BITS / 8 at most."""
    bits = bits_for(keys.count())
    out = np.zeros(bits // 8, np.uint8)
    for row in _parts(keys, key, bits).toLocalIterator():
        out[row["_part"] * 4096 : (row["_part"] + 1) * 4096] = np.frombuffer(row["_bits"], np.uint8)
    return out


class Sieve:
    """A bitmap of text hashes: texts outside it are surely not wanted. Its size follows the number of texts wanted up to a
    fixed bound (MOST_BITS), so every task gets it and texts are sifted where they are read."""

    def __init__(self, wanted: DataFrame) -> None:
        self.bits = bits_for(wanted.count())
        self.parts = _parts(wanted, "ch", self.bits)

    def marked(self, texts: DataFrame) -> DataFrame:
        """texts with the column ``maybe``."""
        at = F.col("ch").bitwiseAND(F.lit(self.bits - 1))
        part = texts.withColumn("_part", F.shiftright(at, 15)).withColumn("_at", at.bitwiseAND(F.lit(32767).cast("long")))
        byte = F.expr("conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10)").cast("int")
        held = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0
        joined = part.join(F.broadcast(self.parts), "_part", "left")
        return joined.withColumn("maybe", F.coalesce(held, F.lit(False))).drop("_part", "_at", "_bits")


def _string_rows(width: int):
    """For each wanted span the digests of the strings that start in it, in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ch, cx, text, wanted in zip(*(batch.column(k).to_pylist() for k in (*TEXT, "text", "wanted")), strict=True):
                for w in wanted:
                    starts = range(w["first"], w["first"] + w["n"])
                    found = _digests(text, list(starts), [s + width for s in starts])
                    out.append((w["core"], w["span"], w["whole"], ch, cx, w["first"], found))
                    if len(out) > 5_000:
                        yield _strings(out)
                        out = []
            if out:
                yield _strings(out)

    return rows


STRINGS = "core long, span long, whole boolean, ch long, cx long, first long, strings array<long>"


def _strings(out: list[tuple]) -> pa.RecordBatch:
    core, span, whole, *long, found = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x, pa.int64()) for x in (core, span)), pa.array(whole), *(pa.array(x, pa.int64()) for x in long), pa.array(found, pa.list_(pa.int64()))],
        [x.split()[0] for x in STRINGS.split(", ")],
    )


def _merged(cover: list[dict] | None, told: bool) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((c["a"], c["b"]) for c in cover or () if c["told"] == told):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each text's intervals and take them out; add up the pieces that are only told."""
    for batch in batches:
        kept, removed, spans, shared, size = [], [], [], [], []
        for text, cover in zip(batch.column("text").to_pylist(), batch.column("cover").to_pylist(), strict=True):
            merged = _merged(cover, False)
            edges = [0, *(x for m in merged for x in m), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(sum(b - a for a, b in merged))
            spans.append([{"a": a, "b": b} for a, b in merged])
            shared.append(sum(b - a for a, b in _merged(cover, True)))
            size.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array(x, pa.int64()) for x in (size, removed, shared)),
                pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_shared", "spans", "kept"],
        )


OUT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_shared long, spans array<struct<a:long,b:long>>, kept binary"


def covers(texts: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(ch, cx, cover): intervals of bytes that go, and of pieces that are told, of each class of equal texts that has any."""
    classes = texts.groupBy(*TEXT, F.octet_length("text").cast("long").alias("size")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("one")
    )
    classes = scratch.put("classes", classes)
    repeats, pieces = doubled(texts, width, scratch)
    left = scratch.put("left", repeated(repeats, scratch, "core"))
    scratch.drop("repeats")
    place = F.xxhash64("ch", "cx", "idx")
    spans = scratch.put(
        "spans",
        left.groupBy("core", "span")
        .agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.min(F.struct("ch", "cx", "first", "n")).alias("at"))
        .select("core", "span", (F.col("lo") != F.col("hi")).alias("whole"), "at"),
    )
    # spans to compare start by start: those of cores with a span found once, and more than one span
    unsure = spans.groupBy("core").agg(F.min("whole").alias("sure"), F.count(F.lit(1)).alias("k")).where("k > 1 and not sure")
    wanted = scratch.put(
        "wanted",
        spans.join(unsure.select("core"), "core").select("at.ch", "at.cx", F.struct("at.first", "at.n", "core", "span", "whole").alias("w")),
    )
    # one text of each class is enough, and so no repeated work for copies
    one = wanted.groupBy(*TEXT).agg(F.collect_list("w").alias("wanted")).join(classes.select(*TEXT, "one"), TEXT)
    maybe = Sieve(wanted.select("ch")).marked(texts.select(*TEXT, "doc_id", "text")).where("maybe")
    chosen = maybe.join(one.hint("shuffle_hash"), TEXT).where(F.col("doc_id").eqNullSafe(F.col("one"))).select(*TEXT, "text", "wanted")
    strings = scratch.put("strings", chosen.mapInArrow(_string_rows(width), STRINGS))
    scratch.drop("wanted")
    # a string is found once in a span, so one of two spans is elsewhere
    each = strings.select("core", "span", F.explode("strings").alias("string"))
    twice = each.groupBy("core", "string").agg(F.min("span").alias("lo"), F.max("span").alias("hi")).where("lo <> hi")
    alone = strings.where("not whole").select("core", *TEXT, "first", F.posexplode("strings").alias("k", "string"))
    start, gone = (F.col("first") + F.col("k")).alias("a"), F.lit(False).alias("told")
    single = alone.join(twice.select("core", "string"), ["core", "string"]).select(*TEXT, gone, start, (start + width).alias("b"))
    whole = left.join(spans.where("whole").select("core", "span"), ["core", "span"]).select(
        *TEXT, gone, F.col("first").alias("a"), (F.col("first") + F.col("n") - 1 + width).alias("b")
    )
    copies = classes.where("copies > 1").select(*TEXT, "size", F.explode(F.array(F.lit(False), F.lit(True))).alias("told"))
    copies = copies.where(F.col("size") >= F.when(F.col("told"), PIECE).otherwise(width))
    copies = copies.select(*TEXT, "told", F.lit(0).cast("long").alias("a"), F.col("size").alias("b"))
    found = whole.union(single).union(copies).union(pieces)
    out = scratch.put("cover", found.groupBy(*TEXT).agg(F.collect_set(F.struct("told", "a", "b")).alias("cover")))
    scratch.drop("classes", "left", "spans", "strings", "pieces", *scratch.made)
    return out


def remove_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_shared, spans (removed, as [a, b) of bytes) and kept (the other bytes) of every row."""
    texts = keep_only(docs, doc_id="long", text="string").select(
        "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    texts = texts.withColumns({"ch": F.xxhash64("text"), "cx": F.xxhash64(F.lit(1), "text")})
    scratch = Scratch(docs.sparkSession)
    with shuffles_released(docs.sparkSession):
        cover = covers(texts, width, scratch)
    sifted = Sieve(cover.select("ch")).marked(texts)
    maybe, plain = sifted.where("maybe"), sifted.where("not maybe")
    none = F.expr("cast(array() as array<struct<a:long,b:long>>)")
    cutting = maybe.join(cover.hint("shuffle_hash"), TEXT, "left").select("doc_id", "text", "cover")
    zero = F.lit(0).cast("long")
    untouched = plain.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_shared"), none.alias("spans"), F.col("text").alias("kept")
    )
    return cutting.mapInArrow(_cut_rows, OUT_SCHEMA).union(untouched)


def span_count(spans: Column | str) -> Column:
    return F.size(spans).cast("long")
