"""Stacking and ordering of bar tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.timeframes import TIMEFRAMES, Timeframe, section_no


def concat_timeframes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Stack separately stored bar tables, tagging each with its label.

    Columns are matched by name and duplicates are kept.
    """
    if not tables:
        raise ValueError("no tables to concatenate")
    tagged = [df.withColumn("timeframe", F.lit(label)) for label, df in tables.items()]
    return reduce(DataFrame.unionByName, tagged)


def order_bars(
    bars: DataFrame, timeframes: Sequence[str | Timeframe] = TIMEFRAMES
) -> DataFrame:
    """Sort by symbol, then section in declared order, then time.

    A global sort by ranges of all three keys, so a large symbol spreads over
    several tasks.
    """
    return bars.orderBy("symbol", section_no(F.col("timeframe"), timeframes), "timestamp")
