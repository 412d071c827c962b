"""The ordered timeframe list and lookups on it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Timeframe(NamedTuple):
    """A display label, the exchange's code for it and its length."""

    label: str
    code: str
    seconds: int


# Labels and codes, in document order, with their lengths.
TIMEFRAMES = (
    Timeframe("1D", "1d", 86_400),
    Timeframe("4H", "4h", 14_400),
    Timeframe("1H", "1h", 3_600),
    Timeframe("15M", "15m", 900),
    Timeframe("5M", "5m", 300),
)


def resolve(timeframes: Sequence[str | Timeframe] = TIMEFRAMES) -> tuple[Timeframe, ...]:
    """Turn labels into timeframes, keeping the order given.

    A ``Timeframe`` of your own passes through unchanged. Units are never read
    out of a label: ``15M`` is minutes here and months elsewhere.
    """
    known = {frame.label: frame for frame in TIMEFRAMES}
    frames = []
    for item in timeframes:
        if isinstance(item, Timeframe):
            frames.append(item)
        elif item in known:
            frames.append(known[item])
        else:
            raise ValueError(f"unknown timeframe {item!r}; known: {', '.join(known)}")
    labels = [frame.label for frame in frames]
    if not frames or len(set(labels)) < len(labels):
        raise ValueError(f"timeframes must be distinct and not empty: {labels}")
    if any(frame.seconds < 1 for frame in frames):
        raise ValueError("a timeframe must last at least one second")
    return tuple(frames)


def section_no(label: Column, timeframes: Sequence[str | Timeframe] = TIMEFRAMES) -> Column:
    """Position of a label in the ordered list, from 0; null for an unknown label."""
    labels = F.array(*[F.lit(frame.label) for frame in resolve(timeframes)])
    return F.nullif(F.array_position(labels, label), F.lit(0).cast("long")) - 1


def with_timeframe_info(
    bars: DataFrame, timeframes: Sequence[str | Timeframe] = TIMEFRAMES
) -> DataFrame:
    """Add ``section_no``, ``code`` and ``seconds`` for each row's timeframe label.

    The list is a literal in the plan, so nothing is joined or broadcast.
    """
    frames = resolve(timeframes)
    number = section_no(F.col("timeframe"), frames)
    codes = F.array(*[F.lit(frame.code) for frame in frames])
    seconds = F.array(*[F.lit(frame.seconds).cast("long") for frame in frames])
    return bars.withColumns(
        {
            "section_no": number,
            "code": F.get(codes, number.cast("int")),
            "seconds": F.get(seconds, number.cast("int")),
        }
    )
