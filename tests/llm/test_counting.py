"""Centroids, collocations and token counts: brute force, odd rows, the pieces that must be exact."""

from __future__ import annotations

import hashlib
import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from causeway.llm import centroids, collocations, queries, tokencount
from pyspark.core.broadcast import Broadcast

# 11 -- centroids


def clusters_by_hand(vectors, k, rounds):
    """(rows kept, centroids, cluster and distance of each)"""
    kept = [(i, [math.floor(1024 * int(v)) if abs(v) > 2**60 else math.floor(1024 * v) for v in e]) for i, e in vectors
            if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))[:k]
    c = [list(e) for _, e in start]

    def nearest(e):
        return min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        at = [nearest(e)[1] for _, e in kept]
        for j in range(len(c)):
            own = [e for (_, e), a in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    return kept, c, [nearest(e) for _, e in kept]


def test_centroids_equal_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 0.3, 64) + (i % 3)]) for i in range(60)]
    rows += [(90, rows[0][1]), (0, rows[0][1]), (91, None), (92, [1.0]), (93, [float("nan")] * 64), (94, [float("inf")] * 64), (95, [None] + [0.0] * 63), (None, rows[5][1])]
    rows += [(96, [0.0] * 64), (97, [0.0] * 64), (98, [3e8] * 64), (99, [-7.5e30] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, VEC_ID int")
    got = centroids.cluster(df.repartition(3), k=8, rounds=4).collect()
    kept, c, near = clusters_by_hand(rows, 8, 4)
    total = sum(d for d, _ in near)
    fits = lambda x: x if x < 2**63 else None
    want = [
        (i, j, fits(d), fits(sum(x for x, y in near if y == j)), fits(total), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
        for (i, _), (d, j) in zip(kept, near, strict=True)
    ]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_centroids_of_little(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(none).collect() == []
    two = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64)], "vec_id long, embedding array<float>")
    assert [(r.cluster, r.distance, r.inertia) for r in centroids.cluster(two).collect()] == [(0, 0, 0)] * 2  # a tie goes to the smaller number


@pytest.mark.parametrize("bound", [3, 1000, 1 << 26, centroids.bound_of(64)])
def test_screening_loses_no_nearest(bound):
    rng = np.random.default_rng(bound)
    x = rng.integers(-bound + 1, bound, (400, 64))
    rows = rng.integers(-bound + 1, bound, (6, 64)).tolist()
    rows += [rows[2], (np.array(rows[3]) + rng.integers(0, 2, 64) * (bound > 3)).clip(1 - bound, bound - 1).tolist()]
    c = centroids.Centroids(rows)
    k, d = c.nearest(x)
    assert [v.tolist() for v in c.nearest_exact(x.astype(object))] == [k.tolist(), d.tolist()]
    listed = c.shortlist(x)
    assert listed[np.arange(len(x)), k].all() and listed.sum() < x.shape[0] * 5


def test_digits_add_up():
    for v in (0, 1, -1, 1 << 30, -(1 << 30) - 1, 3**90, -(7**80)):
        assert sum(d << (centroids.DIGIT * i) for i, d in enumerate(centroids._digits(v))) == v


# 12 -- collocations


def phrases_by_hand(docs, least, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in candidates.items():
        score, _, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        held = [b for (x, v), b in candidates.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= 50 * a for b in held):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


ODD_DOCS = [
    ("en", "New York, new york! NEW YORK; new\tyork: a b c a b c. a b c " * 4), ("en", None), (None, ""), (None, "x y. " * 30), ("und", "x y " * 5),
    ("fr", "é è é è é è é è é è é è é è É È"), ("en", "    nul\x00 nul\x00 " * 12), ("de", "ja"), ("en", "a b\x0bc a b\x85c " * 15), ("en", "w" * 100_000 + " z"),
]


@pytest.mark.parametrize(("least", "top", "slice_keys"), [(10, 2000, 1 << 21), (2, 7, 5)])
def test_phrases_equal_hand(spark, monkeypatch, least, top, slice_keys):
    monkeypatch.setattr(collocations, "STEP", 50)
    docs = ODD_DOCS + [("en", " ".join(random.Random(s).choices("abcdef", k=60))) for s in range(8)]
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "lang string, text string, a int, LANG string").repartition(3)
    got = {tuple(r) for r in collocations.collocations(df, least=least, top=top, slice_keys=slice_keys).collect()}
    assert got == phrases_by_hand(docs, least, top) and got


def test_phrases_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", None), ("en", "a b")], "lang string, text string")).collect() == []


def test_words_of_one_hash_change_the_seed(spark):
    """Few bits make words share hashes under the first seed alone, or under all."""
    rows = [("en", f"{a} b{a}. " * 12) for a in "uvwxyz"]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = phrases_by_hand(rows, 10, 99)
    words = [w.encode() for a in "uvwxyz" for w in (a, f"b{a}")]

    def meet(bits, seed):
        return len({collocations._hash(b"en", w, seed) >> (64 - bits) or 1 for w in words}) < len(words)

    # as many bits as make the first seed fail and a later one do
    bits = next(n for n in range(4, 64) if meet(n, 0) and not all(meet(n, s) for s in range(collocations.SEEDS)))
    assert {tuple(r) for r in collocations.collocations(df, top=99, bits=bits).collect()} == want
    with pytest.raises(ValueError, match="share a hash"):
        collocations.collocations(df, bits=2)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 40, (20_000, 3)).astype(np.uint64), axis=0)
    table = collocations.PerfectHash(keys)
    assert sorted(table.slots(*keys.T).tolist()) == list(range(len(keys)))
    assert (table.slots(*(keys + np.uint64(1 << 40)).T) == -1).all()
    assert len(collocations.PerfectHash(np.zeros((0, 3), np.uint64)).slots(*keys[:3].T)) == 3
    with pytest.raises(ValueError, match="distinct"):
        collocations.PerfectHash(np.zeros((2, 3), np.uint64))


def test_driver_builds_no_table_and_keeps_no_broadcast(spark, monkeypatch):
    """Keys of candidates are hashed by tasks, in parts; what was sent is given back, of each slice before the next."""
    built, out, most = [], [], []
    init, send, destroy = collocations.PerfectHash.__init__, type(spark.sparkContext).broadcast, Broadcast.destroy

    def sent(sc, value):
        made = send(sc, value)
        out.append(made)
        most.append(len(out))
        return made

    monkeypatch.setattr(collocations, "PART_KEYS", 4)
    monkeypatch.setattr(collocations.PerfectHash, "__init__", lambda self, keys, *a: (built.append(len(keys)), init(self, keys, *a))[1])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", sent)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (out.remove(self), destroy(self, *a))[1])
    rows = [("en", "a b c d. " * 12), ("fr", "a b a. " * 12)]
    got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), slice_keys=8).collect()}
    assert got == phrases_by_hand(rows, 10, 2000) and got
    assert not any(built) and not out and max(most) <= 5


def test_table_of_a_slice_holds_no_keys():
    """Parts of several seeds and depths: a slot of its own for each key, in a few bits."""
    keys = np.random.default_rng(2).integers(0, 1 << 63, (50_000, 3)).astype(np.uint64)
    at = collocations.slice_of(*keys.T)
    part = (at >> np.uint64(collocations.SLICE_BITS - 3)).astype(int)
    parts = {k: collocations.PerfectHash(keys[part == k], 2.0, 4, False) for k in range(8) if k != 5}
    parts[5] = collocations.PerfectHash(keys[part == 5][:1], 2.0, 4, False)
    held = (part != 5) | (np.arange(len(keys)) == np.flatnonzero(part == 5)[0])
    table = pickle.loads(pickle.dumps(collocations.PartedHash(parts, 3)))
    assert sorted(table.slots(*keys[held].T, at[held]).tolist()) == list(range(len(table))) and len(table) == held.sum()
    assert len(pickle.dumps(table)) < 1.5 * len(table)
    assert len(collocations.PartedHash({}, 0)) == 0


def test_crowded_bitmap_loses_none_and_lets_few_pass(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 15)
    monkeypatch.setattr(collocations, "PIECE_BITS", 13)
    x = np.random.default_rng(3).integers(0, 1 << 48, 53_000).astype(np.uint64)
    held = collocations.Bitmap(spark.createDataFrame([(int(v),) for v in x[:3000]], "m long"), "m")
    assert held.log == 15 and held.has(x[:3000]).all() and held.has(x[3000:]).mean() < 0.05


def test_words_of_a_chunk_are_numbers_of_its_hashes():
    chunk = collocations._Chunk("en")
    chunk.add(b"a b, a  c")
    for i in range(300):
        chunk.add(b"w%d" % i)
    _, _, places, words, hashes, counts, n = chunk.row(0, 64)
    h = collocations._in_order(pa.scalar(places), pa.scalar(hashes)).tolist()
    known = {w: collocations._hash(b"en", w, 0) for w in words.split(b"\n")}
    assert h == [*(known.get(x, 0) for x in (b"a", b"b", b"", b"a", b"c", b"")), *(x for i in range(300) for x in (known[b"w%d" % i], 0))]
    assert n == 304 and len(places) == 4 * len(h) and set(known) == {b"a", b"b", b"c", *(b"w%d" % i for i in range(300))}


# 13 -- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def test_token_counts_equal_library(spark, sf_dir, library):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = {tuple(r) for r in queries.op13_token_counts(spark, sf_dir).collect()}
    counts = [len(library.encode(x or "", add_special_tokens=False)) for x in t["text"]]
    assert got == {(i, len((x or "").encode()), n, n > 2048) for i, x, n in zip(t["doc_id"], t["text"], counts, strict=True)}


def test_token_counts_of_odd_texts(spark, library):
    texts = [None, "", " \n\t", "a" * 300_000, "<|endoftext|>", "x<|endoftext|><|startoftext|>Y <|ENDOFTEXT|>", "it's we'LL 'S ''s", "a\x1cb\x85c\xa0d", "İ ΣΣ ẹ́", "中文 😀"]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)] + [(None, "a b", 1, "q")] * 2, "doc_id long, text string, n_tokens int, TEXT string")
    got = [tuple(r) for r in tokencount.count_tokens(df, queries.tokenizer_path("word_bpe_49k.json"), limit=3).collect()]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 3) for i, t in enumerate(texts)]
    assert sorted(got, key=repr) == sorted([*want, (None, 3, 2, False), (None, 3, 2, False)], key=repr)
    assert tokencount.count_tokens(df.limit(0), queries.tokenizer_path("word_bpe_49k.json")).collect() == []


def test_token_counter_equals_library_on_any_text(library):
    path = queries.tokenizer_path("word_bpe_49k.json")
    counter = tokencount.Counter(path, tokencount.whole_tokens(path), tokencount.plain_characters(path))
    rng = random.Random(3)
    letters = [*map(chr, range(0x250)), *"  \n\tabcABC'tsrevmld0123<|>.,!" * 8, "<|endoftext|>", "'LL", "Σ", "é", "K", "ẞ", "中", "😀", " ", "ﬁ", "Ǆ", "ͅ", "\U0001d400"]
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 24)))
        assert counter.of_text(text) == len(library.encode(text, add_special_tokens=False)), text
