"""Timestamp arithmetic that gives the same answer in every session time zone.

Bars carry ``timestamp_ntz`` values that mean UTC. Many built-ins (``date_trunc``,
``timestampdiff``, ``unix_micros``) take a zoned timestamp and would pull such a
value through the session zone, which moves stamps inside a daylight-saving gap.
The forms below never leave ``timestamp_ntz``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_ms_to_timestamp(ms: Column) -> Column:
    """Epoch milliseconds to a zone-less UTC timestamp."""
    return F.timestamp_add("MILLISECOND", ms.cast("bigint"), F.expr(_EPOCH))


def _since_epoch(ts: Column) -> Column:
    return (ts - F.expr(_EPOCH)).cast("interval second").cast("decimal(18,6)")


def timestamp_to_epoch_ms(ts: Column) -> Column:
    """Zone-less UTC timestamp to whole epoch milliseconds, rounding down."""
    return F.floor(_since_epoch(ts) * 1000).cast("bigint")


def timestamp_to_epoch_us(ts: Column) -> Column:
    """Zone-less UTC timestamp to epoch microseconds."""
    return (_since_epoch(ts) * 1_000_000).cast("bigint")


def epoch_us_to_timestamp(us: Column) -> Column:
    """Epoch microseconds to a zone-less UTC timestamp."""
    return F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH))


def to_utc_ntz(ts: Column) -> Column:
    """A zoned timestamp (an instant) to its zone-less UTC value."""
    return epoch_us_to_timestamp(F.unix_micros(ts))


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned interval that holds ``ts``.

    ``window`` works on the raw microseconds of either timestamp type and
    compiles to integer arithmetic.
    """
    return F.window(ts, f"{seconds} seconds")["start"]
