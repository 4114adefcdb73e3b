"""Reusable column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def ms_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, halves to even."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.bround(micros / F.lit(1000.0)).cast("long")


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double; null where den is 0."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def sign_of(x: Column, tolerance: float = 1e-12) -> Column:
    return F.when(x > tolerance, 1).when(x < -tolerance, -1).when(x.isNotNull(), 0)


def keyed_uniform(*labels: Column) -> Column:
    """In [0, 1): the first 52 bits of the SHA-256 of the labels, joined by the unit separator."""
    digest = F.sha2(F.concat_ws("\x1f", *labels), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_bar(rate: Column) -> Column:
    """Thirteen hex digits that the SHA-256 of the labels, as hex, lies below if their keyed_uniform is less than rate (0 <= rate < 1).

    Digests need not become numbers: rate * 2^52 is exact, and whole numbers are below it if they are below its ceiling.
    """
    return F.lower(F.lpad(F.hex(F.ceil(rate * F.lit(float(1 << 52))).cast("long")), 13, "0"))


def z_value(confidence: float) -> float:
    """The two-sided normal quantile; confidence strictly between 0 and 1."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie strictly between 0 and 1")
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def wilson(successes: Column, trials: Column, confidence: float) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson score interval, within [0, 1]."""
    z = F.lit(z_value(confidence))
    n, p = trials.cast("double"), successes.cast("double") / trials.cast("double")
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def lerp_quantile(sorted_values: Column, q: float) -> Column:
    """Linearly interpolated quantile of a sorted array; null for an empty one."""
    at = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.ceil(at).cast("int"))
    return F.when(F.size(sorted_values) > 0, a + (at - low) * (b - a))


def canonical_json(text: Column) -> Column:
    """A JSON text without white space and with the keys of all objects sorted; numbers that are not whole lose trailing zeros. Null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def reasons(*checks: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in checks]))


def first_code(checks: Sequence[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for cond, code in reversed(checks):
        out = F.when(cond, F.lit(code)).otherwise(out)
    return out
