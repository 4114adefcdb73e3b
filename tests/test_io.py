"""Sources, sinks, validation and streaming."""

from __future__ import annotations

from causeway.operators import validation as v
from causeway.sources import journal, jsonl
from causeway.streaming import live


def test_jsonl_round_trip_and_bad_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"b":1,"a":"x"}\n\n{"a":"y","b":2}\nnot json\n', encoding="utf-8")
    good, bad = jsonl.read_events(spark, str(path), "a string, b long")
    assert sorted((r.a, r.b) for r in good.collect()) == [("x", 1), ("y", 2)]
    assert [r.value for r in bad.collect()] == ["not json"]
    jsonl.write_jsonl(good.orderBy("b").coalesce(1), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":"x","b":1}', '{"a":"y","b":2}']


def test_record_bytes(spark, tmp_path):
    (tmp_path / "r").write_bytes(b"one\r\n\nthree\n")
    rows = jsonl.read_records(spark, str(tmp_path / "r")).orderBy("line").collect()
    assert [(r.line, bytes(r.record), r.is_blank) for r in rows] == [(1, b"one", False), (2, b"", True), (3, b"three", False)]


def test_files_with_lines_are_no_empty_ledgers(spark, tmp_path):
    """Whatever form a path has in listings and in scans, blanks and signs of the folder's name included."""
    at = tmp_path / "i n%20é+"
    at.mkdir()
    (at / "a.jsonl").write_bytes(b"x\n\ny\n")
    (at / "c.jsonl").write_bytes(b"")
    got = sorted((r.path[-7:], r.line, r.code) for r in jsonl.record_faults(spark, str(at)).collect())
    assert got == [("a.jsonl", 2, "blank_record"), ("c.jsonl", None, "empty_ledger")]


def test_rules(spark):
    rows = [("evt_1", "a.b", 1.0), ("x", None, float("nan")), (None, "A", -1.0)]
    df = spark.createDataFrame(rows, "event_id string, event_type string, ms double").withColumnRenamed("ms", "weight")
    df = df.selectExpr("row_number() over (order by weight) as k", "*")
    rules = [v.required("event_id"), v.pattern("event_id", v.EVENT_ID), v.pattern("event_type", v.EVENT_TYPE), v.at_least("weight", 0)]
    got = sorted((r.k, r.rule) for r in v.check(df, "k", rules).collect())
    assert got == [(1, "event_id_missing"), (1, "event_type_malformed"), (1, "weight_too_small"), (3, "event_id_malformed"), (3, "weight_too_small")]
    assert v.not_unique(df, "event_id").count() == 0


def test_live_density(spark, tmp_path):
    rows = [("e1", "human.checkpoint.resolved", "2024-01-01 00:01:00"), ("e2", "action.completed", "2024-01-01 00:02:00"), ("e2", "action.completed", "2024-01-01 00:02:00"), ("e3", "tool.called", "2024-01-03 00:00:00")]
    src = spark.createDataFrame(rows, "event_id string, event_type string, ts string").selectExpr("event_id", "event_type", "timestamp(ts) occurred_at")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = live.deduplicated(stream).writeStream.format("memory").queryName("dedup").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dedup").count() == 3
    q = live.live_density(stream).writeStream.format("memory").queryName("density").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    first = spark.table("density").orderBy("start").first()
    assert (first.n_human, first.n_effective) == (1, 3)


def test_record_bytes_of_split_files(spark, tmp_path):
    """Invalid UTF-8, CR inside a line and CRLF come through; a file in many splits has the lines of the whole."""
    lines = [b"\xff\xfe\x00", b"a\rb\r", b" \t\x0b\r", b"\xed\xa0\x80 " + b"x" * 90, b"\xe2\x80\xa8"] * 200
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes(b"\n".join(lines))
    (tmp_path / "in" / "b.jsonl").write_bytes(b"one\n\n")
    (tmp_path / "in" / "c.jsonl").write_bytes(b"")
    key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key), spark.conf.get(cost)
    try:
        spark.conf.set(key, "997")
        spark.conf.set(cost, "1")
        rows = jsonl.read_records(spark, str(tmp_path / "in"))
        got = {(r.path[-7], r.line): (bytes(r.record), r.is_blank) for r in rows.collect()}
        faults = {(r.path[-7], r.line, r.code) for r in jsonl.record_faults(spark, str(tmp_path / "in")).collect()}
    finally:
        spark.conf.set(key, before[0])
        spark.conf.set(cost, before[1])
    bare = [x[:-1] if x.endswith(b"\r") else x for x in lines]
    want = {("a", i): (x, not x.strip()) for i, x in enumerate(bare, 1)} | {("b", 1): (b"one", False), ("b", 2): (b"", True)}
    assert got == want
    assert faults == {("a", i, "blank_record") for i, x in enumerate(bare, 1) if not x.strip()} | {("b", 2, "blank_record"), ("c", None, "empty_ledger")}


def test_lines_that_are_no_events_have_their_number(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"a":"x"}\n\n[1]\n{"a":"y"}\n{"a":', encoding="utf-8")
    good, bad = jsonl.read_events(spark, str(tmp_path / "e.jsonl"), "a string")
    assert sorted(r.a for r in good.collect()) == ["x", "y"]
    assert sorted((r.line, r.value) for r in bad.collect()) == [(3, "[1]"), (5, '{"a":')]


def test_json_keys_are_sorted_at_all_depths(spark, tmp_path):
    df = spark.sql("select named_struct('z', 1, 'a', named_struct('d', cast(null as int), 'c', array(named_struct('y', 2, 'x', 'é')))) b, 3 a")
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":3,"b":{"a":{"c":[{"x":"é","y":2}],"d":null},"z":1}}'


def test_journal_has_each_batch_once(spark, tmp_path):
    path = str(tmp_path / "journal")
    one = spark.createDataFrame([(1, "approval.enqueued", "a"), (2, "approval.enqueued", "b")], journal.ENTRY)
    two = spark.createDataFrame([(3, "approval.resolved", "a"), (3, "decision.recorded", "d")], journal.ENTRY)
    assert journal.read(spark, path).count() == 0 and journal.manifest(spark, path).count() == 0
    assert journal.append(one, path, 0) and journal.append(two, path, 1)
    before = [tuple(r) for r in journal.listing(spark, path).collect()]
    assert not journal.append(one, path, 0) and not journal.append(one, path, 1)  # a replay, and a batch id with other entries
    assert [tuple(r) for r in journal.listing(spark, path).collect()] == before
    # a writer that died before the manifest named its batch
    one.write.parquet(f"{path}/entries/batch=2")
    assert [tuple(r) for r in journal.listing(spark, path).collect()] == before
    assert journal.append(spark.createDataFrame([(4, "approval.expired", "b")], journal.ENTRY), path, 2)
    assert journal.append(one.limit(0), path, 3)
    assert {(r.object_id, r.last_mutation, r.state_version) for r in journal.state(spark, path).collect()} == {("a", "approval.resolved", 2), ("b", "approval.expired", 2), ("d", "decision.recorded", 1)}
    assert sorted((r.batch, r.n, r.last_seq) for r in journal.manifest(spark, path).collect()) == [(0, 2, 2), (1, 2, 3), (2, 1, 4), (3, 0, None)]


def test_journal_of_a_replayed_stream(spark, tmp_path):
    """Without a checkpoint a restarted stream replays its batches under their ids: the journal does not change."""
    rows = [(i, "approval.enqueued", f"a{i}") for i in range(6)]
    spark.createDataFrame(rows, journal.ENTRY).repartition(3).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "journal")
    for run in range(2):
        stream = spark.readStream.schema(journal.ENTRY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(journal.sink(path)).option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.seq, r.mutation, r.object_id) for r in journal.read(spark, path).collect()) == rows
