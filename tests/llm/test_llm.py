"""The ten operators and the pipeline: brute force, round trips, held-out accuracy, edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from causeway.llm import common, decontaminate, embeddedup, linededup, nearcopies, packing, quality, queries, sharding, simhash, suffixdedup, toxicity, urlfilter
from conftest import same_rows
from pyspark.sql import functions as F

QUERIES, ORACLE = queries.queries(), queries.oracle_sql()
SCHEMA = "doc_id long, text string"
#: Nulls, empty and blank texts, ties, repeated rows and one very long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "same words here"), (6, "same words here"), (6, "same words here"), (7, "x" * 300_000), (None, "same words here"), (8, "é " * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    # further columns with names that the operators use inside
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("score", "fp", "ch", "h1", "dropped", "_bucket", "n_lines", "y")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLE[name])


def documents(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


def test_columns_that_clash_by_case(spark):
    """A TEXT beside text, a Doc_Id beside doc_id: the exact names are read, the others not."""
    rows = [(1, 9, "one line of enough code points\na b c d e f", "x", 0, 1), (2, 9, "insult other words here for all to read", "x", 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, DOC_ID long, text string, TEXT string, toxic int, quality int")
    labels = docs.select().crossJoin(spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, toxic int, quality int"))
    items = spark.createDataFrame([(1, 5, "a b c d e f", "zz")], "item_id long, ITEM_ID long, text string, Text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()] == [(1, 1)]
    assert sharding.shard(docs, sharding.regular_tree(24)).count() == 2
    assert packing.pack(docs, queries.tokenizer_path()).count() == 2
    for mod in (toxicity, quality):
        assert mod.score(common.keep_only(docs, doc_id="long", text="string"), mod.fit(docs, labels)).count() == 2
    assert linededup.dedup_lines(docs).count() == 2 and simhash.near_duplicates(docs).count() == 2
    assert suffixdedup.remove_repeats(docs).count() == 2
    pages = spark.createDataFrame([(1, 2, "http://a.org/", "u")], "page_id long, Page_Id long, url string, URL string")
    assert urlfilter.judge(pages, urlfilter.rules_table(spark, queries.URL_RULES)).first().host == "a.org"
    vectors = spark.createDataFrame([(1, 2, [1.0], 3)], "vec_id long, VEC_ID long, embedding array<double>, Embedding int")
    assert embeddedup.near_duplicates(vectors).first().component_id == 1


def test_leaking_rows_of_null_ids_go(spark):
    """A null id, a repeated one, and columns whose names clash by case."""
    item = "what is the capital of the land? it is the old town by the river"
    rows = [(None, "x", 1, f"so {item} they say"), (None, "x", 2, "clean words"), (None, "x", 3, None), (4, "x", 4, item), (4, "x", 5, "clean words"), (5, "x", 6, "clean words")]
    docs = spark.createDataFrame(rows, "doc_id long, DOC_ID string, n int, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r[2] for r in kept.collect()) == [2, 3, 6]


def test_texts_of_one_id_are_one_node(spark):
    docs = spark.createDataFrame([(5, "a b c"), (5, "x y z"), (3, "x y z"), (4, "a b c")], SCHEMA)
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {3}


# 1 -- decontamination


def test_leaks_equal_brute_force(spark, sf_dir):
    bench = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()
    want = set()
    for doc_id, text in documents(sf_dir):
        held = decontaminate.shingles(decontaminate.words_of(text))
        for item, t in zip(bench["item_id"], bench["text"], strict=True):
            parts = [decontaminate.shingles(p) for p in decontaminate.question_and_answer(t)]
            if all(len(p & held) >= 0.8 * len(p) for p in parts):
                want.add((doc_id, item))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, sf_dir).collect()}
    assert got == want and want


def test_leaks_of_changed_and_split_passages(spark):
    words = [f"word{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (4, "a b")], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(5000))
    one = [*words[:30], "other", *words[31:]]
    half = words[:25]
    docs = spark.createDataFrame(
        [(1, f"{filler} {' '.join(one)} {filler}"), (2, f"{filler} {' '.join(half)} {filler}"), (3, filler), (4, ", ".join(words).upper()), (5, None), (6, "x a b y"), (7, "a x b")], SCHEMA
    )
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    # one word of forty changed: over 0.8 of the whole item's shingles stand
    assert got == {(4, 1), (6, 4), (1, 1)}
    loose = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, overlap=0.6).collect()}
    assert (1, 1) in loose
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == {2, 3, 5, 7}
    split = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, index_bytes=70).collect()}
    assert split == got


def test_leaks_of_nothing(spark, none, odd):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(odd, empty).count() == 0
    assert decontaminate.decontaminate(odd, empty).count() == len(ODD)
    assert decontaminate.leaks(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_no_item_that_passes_scores_below_its_threshold():
    rng = np.random.default_rng(5)
    for _ in range(200):
        words = [f"w{i}" for i in rng.integers(0, 12, rng.integers(3, 40))]
        index = decontaminate.Index([(0, " ".join(words)), (1, "w1 w2 w3 w4 w5 w6")], 0.8)
        k = int(rng.integers(0, 3))
        changed = list(words)
        for i in rng.integers(0, len(words), k):
            changed[i] = "zz"
        held = decontaminate.shingles(changed)
        if all(len(p & held) >= 0.8 * len(p) for p in index.parts[0]):
            assert 0 in index.leaks(" ".join(changed))


def test_leaks_of_items_with_one_word_changed_inserted_or_deleted():
    rng = np.random.default_rng(9)
    items = [(n, " ".join(f"i{n}w{x}" for x in rng.integers(0, 60, n))) for n in (5, 6, 9, 10, 14, 20, 28, 29, 30, 40, 90)]
    items.append((200, "What is asked here of the reader who knows? The answer has six words"))
    index = decontaminate.Index(items, 0.8)
    filler = " ".join(f"f{i}" for i in range(700))
    for at, (_, text) in enumerate(items):
        words = text.split()
        for k in range(len(words)):
            for changed in ([*words[:k], "zz", *words[k + 1 :]], [*words[:k], "zz", *words[k:]], [*words[:k], *words[k + 1 :]]):
                assert at in index.leaks(f"{filler} {' '.join(changed)} {filler}")
        if len(words) >= 10:
            assert at not in index.leaks(f"{filler} {' '.join(words[: len(words) // 2])} {filler}")
            assert at not in index.leaks(f"{filler} {' '.join(words[::-1])} {filler}")


# 2 -- sharding


def test_shards(spark, sf_dir):
    rows = QUERIES["op2_sharding"](spark, sf_dir).collect()
    text = dict(documents(sf_dir))
    slots = defaultdict(list)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(rows) == len(text)


def test_shards_follow_weights_and_move_little(spark, odd, none):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = [sharding.Leaf(s // 4, s // 2, s, 2.0 if s == 0 else 1.0) for s in range(8)]
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else x.weight) for x in tree]
    got = sharding.shard(ids, tree, heavier)
    n = Counter(r.shard for r in got.collect())
    assert abs(n[0] / 40_000 - 2 / 9) < 0.01 and all(abs(n[s] / 40_000 - 1 / 9) < 0.01 for s in range(1, 8))
    # rows move only into the subtree that grew: region 1, and inside it rack 2, and inside it shard 5
    moved = got.where("shard <> grown_shard").select("shard", "grown_shard").distinct().collect()
    assert all(b // 4 == 1 for _, b in moved) and all(b // 2 == 2 for a, b in moved if a // 4 == 1) and all(b == 5 for a, b in moved if a // 2 == 2)
    assert sharding.shard(odd, tree).count() == len(ODD) and sharding.shard(none, tree).count() == 0


# 3 -- packing


def test_pieces_hold_the_tokenizers_ids_and_fit(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = QUERIES["op3_packing"](spark, sf_dir).collect()
    by_doc, room = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        room[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in documents(sf_dir):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids)
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(room) <= -(-total // 1024) + 3


def test_solver_covers_exactly():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60):
        counts = {int(k): int(rng.integers(1, 40)) for k in rng.integers(1, 101, n)}
        plan = packing.solve(counts, 100, rounds=200)
        held = Counter()
        for taken, times in plan:
            assert times > 0 and sum(k * c for k, c in taken.items()) <= 100
            for k, c in taken.items():
                held[k] += c * times
        assert held == counts
    assert packing.solve({}, 100) == []


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    enc = packing.Encoder(queries.tokenizer_path())
    for t in ("", "a  b", "   x \n\n\n y\t\tz ", "<|endoftext|> it's", "naïve 漢字 😀 123,456", "x" * 5000, "a\u00a0b\r\nc\x1fd"):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing_odd_rows(spark, odd, none):
    rows = packing.pack(odd, queries.tokenizer_path(), with_ids=True).collect()
    assert sum(r.piece == 0 for r in rows) == len(ODD)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


# 4 and 10 -- classifiers


def test_machine_learns_pairs_that_weights_alone_cannot(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(1600):
        a, b = rng.random(2) < 0.5
        words = [f"n{k}" for k in rng.integers(0, 50, 8)] + ["insult"] * bool(a) + ["group"] * bool(b)
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(a != b)))
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab, F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, y in labels if i % 4 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95


@pytest.mark.parametrize(("name", "label", "n", "out"), [("op4_toxicity", "toxic", 4, 2), ("op10_quality", "quality", 5, 0)])
def test_held_out_accuracy(spark, sf_dir, name, label, n, out):
    big = sf_dir.replace("sf0.001", "sf0.1")
    rows = QUERIES[name](spark, big).collect()
    lab = pq.read_table(f"{big}/labels.parquet").to_pydict()
    truth = dict(zip(lab["doc_id"], lab[label], strict=True))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == out) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for p, y in held]) > 0.97
    positive = [p for p, y in held if y == 1]
    assert len(positive) > 50 and np.mean(positive) > 0.9
    # no score is shared by many different texts
    texts = defaultdict(set)
    for r in rows:
        texts[r.score].add(r.doc_id)
    distinct = {t: i for i, t in documents(big)}
    one_each = set(distinct.values())
    assert max(len(x & one_each) for x in texts.values()) < 0.05 * len(one_each)


def test_scores_by_plain_python(spark):
    """The scorers against the models' definitions, term by term."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}." if x % 7 else f"W{x}" for x in rng.integers(0, 40, rng.integers(1, 60))) for _ in range(300)] + ["", "x" * 500 + "insult" + "y" * 500]
    lab = [(i, int("w3." in t.lower().split()), int(" w5" in t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    labels = spark.createDataFrame(lab, "doc_id long, toxic int, quality int")
    m = toxicity.fit(docs, labels)
    at = {int(t): i for i, t in enumerate(m.term)}
    for r in toxicity.score(docs, m).collect():
        rows = [m.table[at[x]] for t in set(r.text.encode().lower().split()) for x in toxicity.terms_of(t) if x in at]
        margin = m.bias + sum(v[0] for v in rows) + sum(rows[i][1:] @ rows[j][1:] for i in range(len(rows)) for j in range(i))
        assert r.score == pytest.approx(1 / (1 + np.exp(-(m.a * np.arcsinh(margin) + m.b))), rel=1e-6)
    q = quality.fit(docs, labels)
    for r in quality.score(docs, q).collect():
        w, ratio2 = q.weight[:, sorted(set(quality.Grams().of(r.text).tolist()))].astype(float).sum(1)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(q.a * (w / np.sqrt(max(1.0, ratio2)) + q.bias) + q.b))), rel=1e-5)


def test_classifiers_read_whole_tokens():
    long = "a" * 3000
    assert set(toxicity.terms_of((long + "insult").encode())) != set(toxicity.terms_of((long + "praise").encode()))
    assert set(quality.Grams().of(long + "x")) != set(quality.Grams().of(long + "y"))
    pair, swapped = quality.Grams().of("one two three"), quality.Grams().of("two one three")
    assert set(pair) != set(swapped)


@pytest.mark.parametrize(("mod", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_without_labels_and_on_odd_rows(spark, odd, none, mod, label):
    labels = spark.createDataFrame([], f"doc_id long, {label} int")
    rows = mod.score(odd, mod.fit(odd, labels)).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (5, 1), (5, 0)], f"doc_id long, {label} int")
    rows = mod.score(odd, mod.fit(odd, some)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert mod.score(none, mod.fit(none, some)).count() == 0


# 5 -- URL filters


def test_url_edge_cases(spark):
    rows = [None, "no scheme", "http://", "HTTP://A.Example.ORG", "http://x.example.org/en/100?q#f", "http://example.org/es/", "http://notexample.org/es/", "http://a.com/de/x", "http://com/fr/", "http://.com/de/", "http://x.com?/de/", "s://http://a.org/"]
    pages = spark.createDataFrame([(1, u) for u in rows], "page_id long, url string")
    got = Counter((r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rules_table(spark, queries.URL_RULES)).collect())

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = re.match("[^/?#]*", rest)[0] if rest is not None else ""
        path = re.match("[^?#]*", rest[len(host) :])[0] if rest is not None else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, rule, verdict

    assert got == Counter(map(brute, rows))
    nothing = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in urlfilter.judge(pages, nothing, default="block").collect()} == {"block"}


# 6 -- line dedup


def test_lines_odd_rows(spark, odd, none):
    line = "a line of enough code points"
    docs = spark.createDataFrame(
        [(1, line), (2, f"x\n {line.upper()}\t\n{line}"), (3, f"{line}\n{line}"), (3, f"{line}\n{line}"), (4, "short"), (None, line), (5, None)], SCHEMA
    )
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(docs).collect()), key=str)
    want = [(1, "", 1, 1), (2, "x", 3, 2), (3, f"{line}\n{line}", 2, 0), (3, f"{line}\n{line}", 2, 0), (4, "short", 1, 0), (None, line, 1, 0), (5, "", 1, 0)]
    assert got == sorted(want, key=str)
    assert linededup.dedup_lines(odd).count() == len(ODD) and linededup.dedup_lines(none).count() == 0


def test_bitmaps_of_many_lines(spark):
    lines = [f"shared line number {i:04d} of many" if i % 3 else f"own {i}" for i in range(500)]
    docs = spark.createDataFrame([(d, "\n".join(lines)) for d in (1, 2, 3)], SCHEMA)
    rows = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert rows[3].n_dropped == 0 and rows[1].n_dropped == sum(i % 3 > 0 for i in range(500))
    assert rows[2].text == "\n".join(x for x in lines if x.startswith("own"))


# 7 -- SimHash


def brute_components(prints: dict) -> dict:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_simhash_components_equal_brute_force(spark, sf_dir):
    docs = documents(sf_dir)
    rng = np.random.default_rng(4)
    near = [(10_000 + i, " ".join([*docs[i % 20][1].split(), *[f"z{rng.integers(9)}"] * (i % 4)])) for i in range(60)]
    frame = spark.createDataFrame([*docs, *near], SCHEMA)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in [*docs, *near]}
    want = brute_components(prints)
    assert all(got[i] == (int(np.uint64(prints[i]).astype(np.int64)), want[i]) for i in prints)


def test_all_links_are_found_whatever_the_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base:
        for k in (1, 2, 3, 4):
            values.add(int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)))
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    want = {tuple(sorted((a[0], b[0]))) for a in signed for b in signed if a < b and ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 3}
    for cost in (0.0001, 20.0, 1e9):
        monkeypatch.setattr(simhash, "PROBE_COST", cost)
        got = {(r.a, r.b) for r in simhash.links(frame).collect()}
        assert got == want and want


def test_thresholds_are_allotted_at_least_cost():
    assert simhash.allot([[0, 1, 5, 9, 99], [0, 2, 30, 99, 999]], 3) == [2, 0]
    assert simhash.allot([[0, 1], [0, 1], [0, 1], [0, 1]], 3) == [0, 0, 0, 0]


def test_fingerprint_by_definition():
    import xxhash

    text = "The quick\tBrown fox É jumps The quick brown fox"
    w = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint("a b c d " * 60_000) == simhash.fingerprint("a b c d " * 60_000)


def test_simhash_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5} and [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[2000 + i] for i in range(200)} | {got[1000]} == {1000}
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# 8 -- suffix dedup


def brute_cover(texts: list[bytes], width: int) -> list[tuple[int, bytes]]:
    where = defaultdict(list)
    for d, t in enumerate(texts):
        for s in range(len(t) - width + 1):
            where[t[s : s + width]].append((d, s))
    gone = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for d, s in places:
                gone[d][s : s + width] = b"\1" * width
    return [(sum(g), bytes(c for c, x in zip(t, g, strict=True) if not x)) for t, g in zip(texts, gone, strict=True)]


@pytest.mark.parametrize("width", [60, 150])
def test_repeats_equal_brute_force(spark, width):
    rng = np.random.default_rng(width)

    def noise(n):
        return bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()

    shared = [noise(int(rng.integers(width - 5, 4 * width))) for _ in range(8)]
    texts = [noise(int(rng.integers(0, 500))) + shared[i % 8][int(rng.integers(0, 9)) :] + noise(int(rng.integers(0, 300))) for i in range(60)]
    texts += ["ab" * 300, "xyz" * 100 + "q" + "xyz" * 100, "", texts[0], texts[0], "a" * width, "b" * (width + 1), noise(width - 1), "né" * 200]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffixdedup.remove_repeats(frame, width).collect()}
    want = brute_cover([t.encode() for t in texts], width)
    assert [got[i] for i in range(len(texts))] == want


def test_long_text_in_steps(monkeypatch):
    text = bytes(np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8))
    whole = suffixdedup.anchors(text, 20)
    monkeypatch.setattr(suffixdedup, "STEP", 64)
    parts = suffixdedup.anchors(text, 20)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_suffix_odd_rows(spark, odd, none):
    rows = suffixdedup.remove_repeats(odd, 400).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.n_removed for r in rows}[7] == 300_000
    assert suffixdedup.remove_repeats(none, 400).count() == 0


# 9 -- embeddings


def test_embedding_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.01]), (3, [1.0, 0.01]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddedup.near_duplicates(frame).collect()), key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (None, 4, None, False), (11, 0, 11, True), (10, 0, 10, True)]
    want += [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9)]
    assert got == sorted(want, key=str)
    assert embeddedup.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_of_one_id_are_one_node(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [0.0, 1.0]), (2, [1.0, 0.001])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 0, False), (2, 1, 0, False)]


def test_ties_join_components():
    rng = np.random.default_rng(7)
    for _ in range(50):
        i, j = rng.integers(0, 40, (2, 60))
        root = np.arange(40)
        kept = embeddedup._ties(i, j, root)
        want = list(range(40))
        for a, b in zip(i, j, strict=True):
            x, y = sorted((want[a], want[b]))
            want = [x if w == y else w for w in want]
        assert root.tolist() == want and len(kept) == 40 - len(set(want))


def test_links_of_many_intervals(spark, monkeypatch):
    monkeypatch.setattr(embeddedup, "INTERVAL", 50)
    monkeypatch.setattr(embeddedup, "STRIP_BYTES", 12 * 8 * 100)
    monkeypatch.setattr(embeddedup, "SMALL", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    x = (centres[rng.integers(0, 40, 600)] + rng.normal(size=(600, 12)) * 0.15).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddedup.near_duplicates(frame, 0.95).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert [got[i] for i in range(600)] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


# the pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    import corpus_pipeline as p

    docs = common.table(spark, sf_dir, "documents")
    toxic = p.drop_toxic(spark, docs, sf_dir).persist()
    assert toxic.columns == docs.columns
    lines = p.drop_lines(spark, toxic, sf_dir).persist()
    rows = {r.doc_id: r.text for r in toxic.collect()}
    held = defaultdict(set)

    def key(x):
        return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    for i, t in rows.items():
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    want = {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i) for i, t in rows.items()}
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())
    near = p.drop_near_duplicates(spark, lines, sf_dir).persist()
    words = {i: (t or "").encode().lower().split() for i, t in want.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items()}
    group = {i: i for i in want}
    for b in sorted(want):
        for a in sorted(want):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, g in group.items() if i == g)
    clean = p.drop_leaks(spark, near, sf_dir).persist()
    leaks = {r.doc_id for r in decontaminate.leaks(near, common.table(spark, sf_dir, "benchmark")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - leaks
    out = p.run(spark, sf_dir)
    kept = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in clean.collect()}
    assert {r.doc_id for r in out.collect()} == set(kept)
    spark.catalog.clearCache()


def test_near_dedup_stage_equals_brute_force_jaccard(spark, sf_dir):
    """Word changes that leave five-word similarity at 0.8 or more link, fewer shared shingles do not, whatever the fingerprints say."""
    import corpus_pipeline as p

    rng = np.random.default_rng(3)
    texts = [t for _, t in documents(sf_dir)][:60]
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 4000, 120)]
        texts.append(" ".join(words))
        for _ in range(3):
            changed = list(words)
            for at in rng.integers(0, 120, rng.integers(1, 5)):
                changed[at : at + 1] = [[], ["other"], [changed[at], f"more{k}"]][rng.integers(0, 3)]
            texts.append(" ".join(changed))
    texts += ["", None, " ", "a b c", "A  b c", "a b d"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    held = []
    for t in texts:
        w = (t or "").encode().lower().split()
        held.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(held[a] & held[b]) >= 4 * len(held[a] | held[b]):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    prints = [simhash.fingerprint(t) for t in texts]
    assert any(group[i] != i and all((prints[i] ^ prints[j]).bit_count() > 3 for j in range(len(texts)) if j != i) for i in range(len(texts)))
    given = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in p.drop_near_duplicates(spark, given, sf_dir).collect())
    assert got == sorted(set(group))


def test_near_dedup_judges_texts_without_an_id(spark, sf_dir):
    """They go if a document with an id is in their group, wherever the ids lie, and one text of their own groups stays."""
    import corpus_pipeline as p

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for ids in ([1, 2], [-(1 << 63), (1 << 63) - 1], [5, (1 << 63) - 1]):
        texts = [(ids[0], a), (None, a), (None, a + " more"), (None, b), (None, b), (None, b.upper()), (ids[1], "alone"), (None, "none like it"), (None, None), (None, "")]
        given = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)
        got = [(r.doc_id, (r.text or "").lower()) for r in p.drop_near_duplicates(spark, given, sf_dir).collect()]
        assert sorted(got, key=str) == sorted([(ids[0], a), (ids[1], "alone"), (None, b), (None, "none like it"), (None, "")], key=str)


def test_parities_bound_how_many_hashes_differ():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 900), (64, 65), (128, 128), (700, 640), (5000, 4100)):
        both = rng.integers(-(1 << 63), 1 << 63, n + m, np.int64)
        for shared in (0, min(n, m) // 2, min(n, m) - 1):
            x, y = both[:n], np.concatenate([both[:shared], both[n : n + m - shared]])
            least = nearcopies.least_apart(nearcopies.parities(x), nearcopies.parities(y))
            assert least <= n + m - 2 * shared and least == nearcopies.least_apart(nearcopies.parities(y), nearcopies.parities(x))
    far = rng.integers(-(1 << 63), 1 << 63, (2, 600), np.int64)
    assert nearcopies.least_apart(*map(nearcopies.parities, far)) > 1200 / 9 and nearcopies.least_apart(*[nearcopies.parities(far[0])] * 2) == 0


def test_near_copies_moves_no_texts_for_a_shared_passage(spark, monkeypatch):
    """Texts that share rare shingles and little else are told apart before their texts move; written pairs are those that link."""
    rng = np.random.default_rng(6)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    passage, copy = words(12), words(300)
    docs = spark.createDataFrame([(i, f"{passage} {words(90)}") for i in range(40)] + [(50, copy), (51, f"{copy} end")], "doc_id long, text string")
    put, pairs = common.Scratch.put, []

    def counted(self, name, df, **options):
        out = put(self, name, df, **options)
        if name.startswith("pairs"):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "put", counted)
    monkeypatch.setattr(nearcopies, "COMMON_FROM", 1000)  # the passage is not known for common, as where few of its documents are drawn
    assert {(r.doc_id, r.component_id) for r in nearcopies.near_copies(docs).collect()} == {(50, 50), (51, 50)}
    assert sum(pairs) == 1


def test_stages_take_odd_and_empty_tables(spark, sf_dir):
    import corpus_pipeline as p

    full = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (full, full.limit(0)):
        for _, stage in p.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == p.COLUMNS
            stage(spark, docs, sf_dir).collect()
        p.pack(spark, docs, sf_dir).collect()
