"""Hash chains over ordered records: sealing, anchors and verification.

A record's digest is the SHA-256 of its exact bytes; a chain digest is the SHA-256 of a domain tag, the chain digest
before (32 zero bytes at first) and the record's digest. Sealing is sequential by definition: the digests of a run, never
the records, are sorted in one task and streamed through it, with only the head of the chain kept. Verification is not: up to a
ledger's first failure all told chain digests are right, so each place is checked against the one told before it, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import first_code
from ..functions.lineage import cut

#: Ends in NUL so that no tag is the beginning of another. Pass another for chains that were sealed under it.
DOMAIN = b"causeway/chain/v1\0"
#: Records that are folded at a time.
BLOCK = 10_000
PREFIX, GENESIS = "sha256:", bytes(32)
# Fixed values of the profile that sidecars and anchors name.
HASH_ALGORITHM, RECORD_ENCODING = "sha256", "exact-bytes"
SIDECAR = "run_id string, ledger_seq long, event_id string, record_digest string, previous_chain_digest string, chain_digest string"


def parse(records: DataFrame) -> DataFrame:
    """records (ledger, position, record) with run_id, ledger_seq and event_id from their JSON, and whether that is sound."""
    fields = F.from_json(F.col("record").cast("string"), "run_id string, ledger_seq long, event_id string")
    out = records.withColumn("_f", fields).select(*records.columns, "_f.run_id", "_f.ledger_seq", "_f.event_id")
    return out.withColumn("is_sound", F.col("run_id").isNotNull() & F.col("ledger_seq").isNotNull() & F.col("event_id").isNotNull())


def _folded(domain: bytes, block: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, run, head = [x.split()[0] for x in SIDECAR.split(", ")], (), None
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                before, after = [], []
                for run_id, digest in zip(part.column("run_id").to_pylist(), part.column("digest").to_pylist(), strict=True):
                    if run != (run_id,):
                        run, head = (run_id,), None
                    before.append(head and PREFIX + head)
                    head = sha256(domain + (bytes.fromhex(head) if head else GENESIS) + bytes.fromhex(digest)).hexdigest()
                    after.append(PREFIX + head)
                told = pa.array([PREFIX + x for x in part.column("digest").to_pylist()], pa.string())
                keys = [part.column(c) for c in names[:3]]
                yield pa.RecordBatch.from_arrays([*keys, told, pa.array(before, pa.string()), pa.array(after, pa.string())], names)

    return fold


def seal(records: DataFrame, domain: bytes = DOMAIN, block: int = BLOCK) -> DataFrame:
    """The sidecar of records (run_id, ledger_seq, event_id, record): one row for each record; a run's first has no previous digest.

    Records without ledger_seq come first; equal ones go by event_id and digest. A null record counts as an empty one.
    """
    digest = F.sha2(F.coalesce("record", F.lit(b"")), 256).alias("digest")
    slim = records.select(F.col("run_id").cast("string"), F.col("ledger_seq").cast("long"), F.col("event_id").cast("string"), digest)
    ordered = slim.repartition("run_id").sortWithinPartitions("run_id", "ledger_seq", "event_id", "digest")
    return ordered.mapInArrow(_folded(domain, block), SIDECAR)


def anchors(sidecar: DataFrame) -> DataFrame:
    """One row for each run: its count, first and last event and the head of its chain."""
    at = F.col("ledger_seq")
    return sidecar.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("event_id", at).alias("first_event_id"),
        F.max_by("event_id", at).alias("last_event_id"),
        F.max_by("chain_digest", at).alias("final_chain_digest"),
    )


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def _profile(side: str, df: DataFrame, prefix: str) -> Column:
    """Whether the profile columns, where df has them, name another profile."""
    wrong = F.lit(False)
    for name, value in (("hash_algorithm", HASH_ALGORITHM), ("record_encoding", RECORD_ENCODING)):
        if name in df.columns:
            wrong = wrong | ~F.col(f"{prefix}_{name}").eqNullSafe(F.lit(value))
    return wrong


def _placed(df: DataFrame, ledger: str, prefix: str, **more: Column) -> DataFrame:
    """df by ledger and place (its column ``position``, or its order by ledger_seq), other columns prefixed; more: over that order."""
    order = F.col("position") if "position" in df.columns else F.col("ledger_seq")
    by = Window.partitionBy(ledger).orderBy(order)
    rest = [F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "position"]
    return df.select(F.col(ledger).alias("_ledger"), F.row_number().over(by).alias("place"), *[c.over(by).alias(k) for k, c in more.items()], *rest)


def verify(
    records: DataFrame, sidecar: DataFrame, anchor: DataFrame, domain: bytes = DOMAIN, ledger: str = "run_id", require_anchor: bool = False
) -> DataFrame:
    """The first failure of each ledger that any of the three tables knows; the anchor is looked at last.

    Returns the ledger, valid, code, position, event_count, checked_records, anchor_checked and head_digest (of the last
    sound record). All comparisons count null as a value of its own. A ledger without an anchor is valid if its chain
    is, with anchor_checked false, or anchor_missing with ``require_anchor``. ``ledger`` names the column that keeps
    ledgers apart (then a record of another run is a failure), a column ``position`` the place in the file, ``is_sound``
    (see parse) whether a record could be read; hash_algorithm and record_encoding of sidecar and anchor are checked
    where they are given. A sidecar row without any value in event_id and digests is no integrity record. An anchor
    names its ledger in ``ledger``; of several of one ledger the least by head counts.
    """
    sound = F.col("is_sound") if "is_sound" in records.columns else F.lit(True)
    rec = records.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    # the digest is taken before anything moves: record bytes are never shuffled
    slim = rec.withColumn("digest", F.sha2(F.coalesce("record", F.lit(b"")), 256)).drop("record")
    both = _placed(slim, ledger, "f", first_run=F.first("run_id")).join(
        _placed(sidecar, ledger, "s", told_before=F.lag("chain_digest")), ["_ledger", "place"], "left"
    )
    raw = F.when(F.col("place") == 1, F.lit(GENESIS)).otherwise(F.unhex(F.substring("told_before", len(PREFIX) + 1, 64)))
    both = both.withColumns(
        {
            "c_record_digest": F.concat(F.lit(PREFIX), "f_digest"),
            "c_chain_digest": F.concat(F.lit(PREFIX), F.sha2(F.concat(F.lit(domain), raw, F.unhex("f_digest")), 256)),
        }
    )
    # in the order in which a position's failures are looked for
    checks = [
        (~F.col("f__sound"), "invalid_record"),
        (_differs("f_ledger_seq", "place"), "ledger_seq_mismatch"),
        (_differs("f_run_id", "first_run"), "run_id_mismatch"),
        (F.coalesce("s_event_id", "s_record_digest", "s_chain_digest").isNull(), "invalid_integrity_record"),
        (_differs("s_ledger_seq", "f_ledger_seq") | _differs("s_event_id", "f_event_id") | _differs("s_run_id", "first_run"), "integrity_identity_mismatch"),
        (_profile("sidecar", sidecar, "s"), "integrity_profile_mismatch"),
        (_differs("s_record_digest", "c_record_digest"), "record_digest_mismatch"),
        (_differs("s_previous_chain_digest", "told_before"), "previous_chain_digest_mismatch"),
        (_differs("s_chain_digest", "c_chain_digest"), "chain_digest_mismatch"),
    ]
    # written once: the first failures and the heads both read it
    coded = cut(both.select("_ledger", "place", "f_event_id", "first_run", F.col("s_chain_digest").alias("chain"), first_code(checks).alias("code")))
    per = coded.groupBy("_ledger").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("code", F.when(F.col("code").isNotNull(), F.col("place"))).alias("chain_code"),
        F.min(F.when(F.col("code").isNotNull(), F.col("place"))).alias("position"),
        F.max_by("chain", "place").alias("head"),
        F.min_by("f_event_id", "place").alias("first_event_id"),
        F.max_by("f_event_id", "place").alias("last_event_id"),
        F.max("first_run").alias("run"),
    )
    before = coded.join(per.select("_ledger", "position"), "_ledger").where(F.col("place") == F.col("position") - 1)
    n_side = sidecar.groupBy(F.col(ledger).alias("_ledger")).agg(F.count(F.lit(1)).alias("n_side"))
    names = ["run_id", "event_count", "first_event_id", "last_event_id", "hash_algorithm", "record_encoding", "final_chain_digest"]
    told = anchor.groupBy(F.col(ledger).alias("_ledger")).agg(F.min(F.struct("final_chain_digest", *[c for c in names[:-1] if c in anchor.columns])).alias("a"))
    told = told.select("_ledger", F.lit(True).alias("told"), *[F.col(f"a.{c}").alias(f"a_{c}") for c in names if c in anchor.columns])
    ledgers = per.select("_ledger").union(n_side.select("_ledger")).union(told.select("_ledger")).distinct()
    out = (
        ledgers.join(per, "_ledger", "left").join(n_side, "_ledger", "left").join(told, "_ledger", "left")
        .join(before.select("_ledger", F.col("chain").alias("head_before")), "_ledger", "left")
        .withColumns({"n": F.coalesce("event_count", F.lit(0)), "n_side": F.coalesce("n_side", F.lit(0)), "told": F.coalesce("told", F.lit(False))})
    )
    anchored = F.col("told")
    final = first_code(
        [
            (F.col("n") != F.col("n_side"), "sidecar_count_mismatch"),
            (F.col("n") == 0, "empty_ledger"),
            *[(F.col("chain_code") == name, name) for _, name in checks],
            (anchored & _differs("a_event_count", "n"), "anchor_event_count_mismatch"),
            (anchored & (_differs("a_run_id", "run") | _differs("a_first_event_id", "first_event_id") | _differs("a_last_event_id", "last_event_id")), "anchor_identity_mismatch"),
            (anchored & _profile("anchor", anchor, "a"), "anchor_profile_mismatch"),
            (anchored & _differs("a_final_chain_digest", "head"), "anchor_head_mismatch"),
            (~anchored & F.lit(require_anchor), "anchor_missing"),
        ]
    )
    out = out.withColumn("code", final)
    unread = F.col("code").isin("sidecar_count_mismatch", "empty_ledger") & F.col("code").isNotNull()
    in_chain = F.coalesce(F.col("code") == F.col("chain_code"), F.lit(False))
    return out.select(
        F.col("_ledger").alias(ledger),
        F.col("code").isNull().alias("valid"),
        "code",
        F.when(in_chain, F.col("position")).cast("long").alias("position"),
        F.col("n").cast("long").alias("event_count"),
        F.when(unread, 0).when(in_chain, F.col("position") - 1).otherwise(F.col("n")).cast("long").alias("checked_records"),
        anchored.alias("anchor_checked"),
        F.when(unread, None).when(in_chain, F.col("head_before")).otherwise(F.col("head")).alias("head_digest"),
    )
