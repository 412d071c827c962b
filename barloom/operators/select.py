"""Row selection by symbol and by timeframe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.timeframes import Timeframe, resolve


def select_symbols(df: DataFrame, symbols: Sequence[str] | DataFrame) -> DataFrame:
    """Keep the rows of the named symbols; pushed into the scan by Catalyst.

    A list becomes one filter expression, which suits up to some thousand names. More come
    as a table with a column ``symbol``, repeated or not: a left semi join that Spark
    broadcasts or shuffles by the table's size. Its symbols reach the scan while the job
    runs, as partitions to read where bars are stored by symbol, or as a Bloom filter.
    """
    if isinstance(symbols, DataFrame):
        # The length test is true for all names. It tells the optimizer that the table
        # selects, without which it plans no such filter at run time.
        names = symbols.where(F.length("symbol") >= 0).select("symbol").distinct()
        return df.join(names, "symbol", "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
    return df.where(F.col("symbol").isin(list(symbols)))


def select_timeframes(df: DataFrame, timeframes: Sequence[str | Timeframe]) -> DataFrame:
    """Keep rows that already carry one of the timeframe labels.

    Stored bars are pruned by partition. When bars are still to be built, pass
    the shorter list to ``bars`` instead, so the others are never formed.
    """
    return df.where(F.col("timeframe").isin([frame.label for frame in resolve(timeframes)]))
