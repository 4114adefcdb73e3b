"""The offline part of witnessing: anchors against records that were fetched from a witness before.

Fetching needs a network and signatures a cryptography package; they are not part of this library. What a signature must
cover is rebuilt here, so that any verifier can be put to ``signed_string``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import canonical_json, first_code

# The two ways in which a record names what its signature covers.
SIGNED_FIELDS_PLAIN = "instant_id|unix_ns|timescale"
SIGNED_FIELDS_WITH_PAYLOAD = "instant_id|unix_ns|timescale|sha256(canonical_json(label,meta))"


def requests(anchors: DataFrame) -> DataFrame:
    """What a witness would be asked to sign: run, digest and a canonical JSON body, with the anchor's other columns as meta.

    An anchor without a digest asks for nothing: it has to be sealed first.
    """
    names = [c for c in ("run_id", "event_count", "first_event_id", "last_event_id", "final_chain_digest") if c in anchors.columns]
    body = F.to_json(F.struct(F.concat(F.lit("anchor:"), "run_id").alias("label"), F.struct(*names).alias("meta")), {"ignoreNullFields": "false"})
    return anchors.where(F.col("final_chain_digest").isNotNull()).select("run_id", F.col("final_chain_digest").alias("digest"), canonical_json(body).alias("body"))


def match(anchors: DataFrame, witnessed: DataFrame) -> DataFrame:
    """run_id and the first code that stands against each anchor's witness record; null if none does.

    witnessed: run_id, instant_id, digest and signature. Two nulls are no match of digests: an anchor without one was never
    witnessed. If there is a column signed_fields, it must name a known scheme.
    """
    checks = [
        (F.coalesce("instant_id", F.lit("")) == "", "missing_instant_id"),
        (~F.coalesce(F.col("digest") == F.col("final_chain_digest"), F.lit(False)), "digest_mismatch"),
        (F.col("signature").isNull(), "unsigned"),
    ]
    if "signed_fields" in witnessed.columns:
        known = F.col("signed_fields").isin(SIGNED_FIELDS_PLAIN, SIGNED_FIELDS_WITH_PAYLOAD)
        checks.append((~F.coalesce(known, F.lit(False)), "unsupported_signed_fields"))
    return anchors.join(witnessed, "run_id", "left").select("run_id", first_code(checks).alias("code"))


def signed_strings(witnessed: DataFrame) -> DataFrame:
    """run_id, signed_string (what the signature must cover; null for an unknown scheme or a missing part) and meta_bound.

    witnessed: run_id, instant_id, unix_ns and reference_timescale as text, label, meta (JSON text) and signed_fields.
    """
    bound = F.col("signed_fields") == SIGNED_FIELDS_WITH_PAYLOAD
    listed = F.to_json(F.array("label"))  # ["..."], or [null]
    label = listed.substr(F.lit(2), F.length(listed) - 2)
    payload = canonical_json(F.concat(F.lit('{"label":'), label, F.lit(',"meta":'), F.coalesce("meta", F.lit("null")), F.lit("}")))
    plain = F.concat(F.col("instant_id"), F.lit("|"), F.col("unix_ns"), F.lit("|"), F.col("reference_timescale"))
    text = F.when(F.col("signed_fields") == SIGNED_FIELDS_PLAIN, plain).when(bound, F.concat(plain, F.lit("|"), F.sha2(payload, 256)))
    return witnessed.select("run_id", text.alias("signed_string"), F.coalesce(bound, F.lit(False)).alias("meta_bound"))
