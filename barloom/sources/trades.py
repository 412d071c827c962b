"""Map any table of priced events to the trade columns the bar builder reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_trades(
    df: DataFrame,
    symbol: Column | str,
    ts: Column | str,
    price: Column | str,
    size: Column | str,
    *extra: str,
) -> DataFrame:
    """Select ``symbol, ts, price, size`` and any extra ordering columns.

    A plain projection, so unused columns are pruned and filters on ``symbol``
    or ``ts`` still reach the file scan.
    """

    def column(item: Column | str) -> Column:
        return F.col(item) if isinstance(item, str) else item

    return df.select(
        column(symbol).alias("symbol"),
        column(ts).alias("ts"),
        column(price).cast("double").alias("price"),
        column(size).cast("double").alias("size"),
        *extra,
    )
