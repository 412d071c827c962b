"""Sums of doubles that do not depend on the order of the rows.

A double sum rounds after every addition, so another partitioning of the same trades gives
another last digit. Here every value is cut into ``LIMBS`` whole numbers, one for each
stretch of ``BITS`` binary exponents. Whole numbers add up exactly in any order and in any
tree of partial sums, so the aggregate stays hash-based and is combined in each task. Only
the last step makes one double of the total, rounded once, to the nearest.

Values must be finite and below 2**116 (8e34); others fail the job. What a value has
below 2**-64 (5e-20) is rounded to that grid, value by value, which again does not depend
on any order. Nulls are skipped, and a group of nulls gives null. Up to 2**33 rows of a
group cannot overflow a limb; beyond that an overflow fails the job and never wraps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS = 6
BITS = 30
LOWEST = -64  # the binary exponent of the first limb's unit
_MASK = (1 << BITS) - 1


def _unit(limb: int) -> float:
    return 2.0 ** (LOWEST + BITS * limb)


def limb_names(name: str) -> list[str]:
    return [f"{name}_limb_{i}" for i in range(LIMBS)]


def limb_sums(name: str, value: str | None = None) -> list[Column]:
    """The aggregates to ask for: sums of the limbs of ``value``, a double.

    Without a value, sums of limb columns that an earlier aggregate left.
    """
    if value is None:
        return [F.sum(limb).alias(limb) for limb in limb_names(name)]
    number = F.expr(value)
    limit = _unit(LIMBS)
    message = F.concat(F.lit("no exact sum of "), number.cast("string"))
    checked = F.when(number.isNull() | (F.abs(number) < limit), number).otherwise(F.raise_error(message).cast("double"))
    sums = []
    for i, limb in enumerate(limb_names(name)):
        part = (checked % F.lit(_unit(i + 1)) if i + 1 < LIMBS else checked) / F.lit(_unit(i))
        sums.append(F.sum((F.rint(part) if i == 0 else part).cast("bigint")).alias(limb))
    return sums


def with_total(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the limb sums of ``name`` replaced by their total, a double.

    Carries go up from limb to limb, once to learn the sign and once over the absolute
    value. The leading two limbs are split into 53 bits and a rest; what lies below the
    rest only matters as being there or not, so one addition rounds correctly.
    """
    limbs = limb_names(name)
    others = [c for c in df.columns if c not in limbs]
    digits = [f"d{i}" for i in range(LIMBS + 1)]

    def carried(rows: DataFrame, sums: list[Column], *more: str) -> DataFrame:
        """Digits of 30 bits each, and what is above them, with the sign, in the last."""
        rows = rows.select(*others, *more, *[s.alias(f"s{i}") for i, s in enumerate(sums)])
        for i in range(LIMBS):
            own = F.col(f"s{i}")
            carry = F.shiftright(own, BITS)
            above = (F.col(f"s{i + 1}") + carry).alias(f"s{i + 1}") if i + 1 < LIMBS else carry.alias(digits[-1])
            later = [f"s{k}" for k in range(i + 2, LIMBS)]
            rows = rows.select(*others, *more, *digits[:i], own.bitwiseAND(F.lit(_MASK)).alias(digits[i]), above, *later)
        return rows

    def combined(top: int) -> Column:
        """The total if ``top`` is the highest digit that is not zero."""

        def digit(i: int) -> Column:
            return F.col(digits[i]) if i >= 0 else F.lit(0).cast("bigint")

        high = digit(top) * F.lit(1 << BITS) + digit(top - 1)
        low = digit(top - 2) * F.lit(1 << BITS) + digit(top - 3)
        below = F.lit(0).cast("bigint")
        for i in range(top - 3):
            below = below.bitwiseOR(digit(i))
        tail = high.bitwiseAND(F.lit(1023))
        is_more = (low.bitwiseAND(F.lit((1 << 18) - 1)) != 0) | (below != 0)
        rest = F.shiftleft(tail, 42).bitwiseOR(F.shiftright(low, 18)).bitwiseOR(is_more.cast("bigint"))
        return ((high - tail).cast("double") + rest.cast("double") * 2.0**-42) * (2.0 ** (LOWEST + BITS * (top - 1)))

    first = carried(df, [F.col(limb) for limb in limbs])
    # A negative total is carried again as its opposite.
    whole = [F.col(d) for d in digits[:-2]] + [F.col(digits[-2]) + F.col(digits[-1]) * F.lit(1 << BITS)]
    signed = first.withColumn("is_negative", F.col(digits[-1]) < 0)
    second = carried(signed, [F.when(F.col("is_negative"), -w).otherwise(w) for w in whole], "is_negative")
    size = combined(1)
    for top in range(2, LIMBS + 1):
        size = F.when(F.col(digits[top]) != 0, combined(top)).otherwise(size)
    return second.select(*others, F.when(F.col("is_negative"), -size).otherwise(size).alias(name))
