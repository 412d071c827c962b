"""Several order columns packed into one number of fixed width.

``min_by`` and ``max_by`` over a struct make Spark sort every row before it aggregates, as
a struct is no fixed-width buffer. A key that packs the columns into a long (or, if that
is too narrow, into a decimal of 38 digits) keeps the aggregate hash-based. Each column
has a declared range, which is checked row by row: a value outside it fails the job and
never spills into its neighbour.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OrderField:
    """A column of whole numbers from ``low`` to ``high``, or of multiples of ``1 / scale``."""

    name: str
    low: int
    high: int
    scale: int = 1

    @property
    def values(self) -> int:
        """How many values the range has."""
        return (self.high - self.low) * self.scale + 1

    def number(self) -> Column:
        """The value's place in the range, from 0, as a long; anything else fails the job."""
        column = F.col(f"`{self.name}`")
        whole = column.cast("bigint") if self.scale == 1 else F.round(column * self.scale).cast("bigint")
        is_exact = column == whole if self.scale == 1 else column == whole.cast("double") / self.scale
        is_inside = F.coalesce(column.between(self.low, self.high) & is_exact, F.lit(False))
        message = F.concat(
            F.lit(f"{self.name} is not within {self.low} to {self.high} in steps of 1/{self.scale}: "),
            F.coalesce(column.cast("string"), F.lit("null")),
        )
        return F.when(is_inside, whole - self.low * self.scale).otherwise(F.raise_error(message).cast("bigint"))


@dataclass(frozen=True)
class PackedOrder:
    """Order by time first, then by ``fields``.

    ``ts`` enters only by its distance from its interval's start, in steps of
    ``microseconds``, and must lie on such a step: on whole days a daily bar needs no room
    for it at all. Rows with a null in a field fail the job.
    """

    fields: Sequence[OrderField]
    microseconds: int = 1

    def column(self, interval_seconds: int) -> Column:
        """The key of a row with ``ts`` and ``start``, the start of its interval."""
        length, step_us = interval_seconds * 1_000_000, self.microseconds
        if length % step_us:
            raise ValueError(f"an interval of {interval_seconds} s is no whole number of steps of {step_us} microseconds")
        steps = length // step_us
        room = steps
        for field in self.fields:
            room *= field.values
        if room > 10**38:
            raise ValueError(f"the declared ranges have {room} combinations, more than 38 digits hold")
        kind = "bigint" if room <= 1 << 63 else "decimal(38,0)"
        off_step = F.raise_error(F.concat(F.lit(f"ts is not on a step of {step_us} microseconds: "), F.col("ts").cast("string")))
        if steps == 1:
            key = F.when(F.col("ts") == F.col("start"), F.lit(0)).otherwise(off_step.cast("int")).cast(kind)
        else:
            apart = (F.col("ts") - F.col("start")).cast("interval second").cast("decimal(18,6)")
            micros = (apart * 1_000_000).cast("bigint")
            whole = F.when(micros % step_us == 0, (micros / step_us).cast("bigint")).otherwise(off_step.cast("bigint"))
            key = (whole if step_us > 1 else micros).cast(kind)
        for field in self.fields:
            key = key * F.lit(field.values).cast(kind) + field.number().cast(kind)
        return key.cast(kind)
