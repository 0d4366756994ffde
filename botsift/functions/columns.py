"""Scalar column expressions.

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "epoch_ms", "day_bucket", "size0", "flag", "follower_ratio",
    "screen_name_length", "label_to_double", "canonical_url", "ratio",
    "api_time_string", "parse_api_time", "DAY_MS", "float32", "following_ratio",
]

DAY_MS = 86_400_000


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds since the epoch, truncating sub-millisecond digits.

    Works on TIMESTAMP_NTZ (how Parquet timestamps load) without depending on
    the session time zone.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, _c(ts))


def day_bucket(ms: str | Column) -> Column:
    """UTC day number of an epoch-ms value (floor division, correct below 0)."""
    return F.floor(_c(ms) / F.lit(DAY_MS))


def size0(arr: str | Column) -> Column:
    """Array length with NULL treated as empty.

    Explicit, because ``size(NULL)`` is NULL under ANSI mode but -1 without it.
    """
    a = _c(arr)
    return F.when(a.isNull(), F.lit(0)).otherwise(F.size(a)).cast("bigint")


def flag(b: str | Column) -> Column:
    """Boolean as 1.0 / 0.0; NULL counts as false."""
    return F.when(_c(b), F.lit(1.0)).otherwise(F.lit(0.0))


def follower_ratio(followers: str | Column, friends: str | Column) -> Column:
    """(followers + 1) / ((followers + 1) + friends), in DOUBLE."""
    f1 = _c(followers).cast("double") + F.lit(1.0)
    return f1 / (f1 + _c(friends).cast("double"))


def following_ratio(friends: str | Column, followers: str | Column) -> Column:
    """friends / followers (the ratio as documented, "#Following/#Followers");
    NULL when there are no followers."""
    fol = _c(followers).cast("double")
    return F.when(fol > 0, _c(friends).cast("double") / fol)


def screen_name_length(name: str | Column) -> Column:
    return F.length(_c(name)).cast("bigint")


def label_to_double(label: str | Column) -> Column:
    """'human' -> 0.0, any other label -> 1.0."""
    return F.when(_c(label) == F.lit("human"), F.lit(0.0)).otherwise(F.lit(1.0))


def canonical_url(entity: str | Column) -> Column:
    """One URL per entity: the expanded URL when present, else the short one."""
    e = _c(entity)
    return F.coalesce(e.getField("expanded_url"), e.getField("url"))


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Integer numerator over integer denominator, divided once in DOUBLE."""
    return _c(numerator).cast("double") / _c(denominator).cast("double")


def api_time_string(ts_ntz: str | Column) -> Column:
    """UTC wall-clock timestamp rendered like the public API's ``created_at``."""
    return F.date_format(_c(ts_ntz), "EEE MMM dd HH:mm:ss '+0000' yyyy")


def parse_api_time(s: str | Column) -> Column:
    """Parse ``EEE MMM dd HH:mm:ss Z yyyy``.

    Spark 3+ cannot parse the day-of-week letter, so it is cut off first; the
    zone offset in the text makes the result independent of the session zone.
    Text that is not such a time gives NULL.
    """
    return F.try_to_timestamp(F.substring(_c(s), 5, 64), F.lit("MMM dd HH:mm:ss Z yyyy"))


def float32(c: str | Column) -> Column:
    """Round a numeric value to FLOAT and keep that rounding.

    ``cast(cast(x AS float) AS double)`` is simplified by the optimizer to
    ``cast(x AS double)`` for integer x (it treats long -> float as widening),
    which silently skips the float rounding.  nanvl (identity for non-NaN
    values) sits between the two casts so the rounding survives.
    """
    f = _c(c).cast("float")
    return F.nanvl(f, f)
