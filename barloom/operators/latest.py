"""Newest N bars of every series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.schemas import MEASURES

DEFAULT_LIMIT = 500
_SALTS = 64


def latest_bars(bars: DataFrame, limit: int = DEFAULT_LIMIT, partitions: int | None = None) -> DataFrame:
    """Keep at most ``limit`` newest bars per symbol and timeframe.

    Up to a threshold (1000 by default) Spark cuts each series to ``limit`` rows
    in every task before the shuffle. Beyond it that cut is off, so a long
    series is first ranked in salted parts: the newest ``limit`` of the whole
    are among the newest ``limit`` of the parts, hence the result is exact and
    the last step sees at most ``salts * limit`` rows of a series (so it grows
    with ``limit``, not with the series). The salt follows from the row alone,
    so filters on symbol or timeframe still pass below the ranking.

    Equal stamps are ranked by their values, so a re-run task picks the same rows.

    With ``partitions`` whole series are dealt over so many tasks and cut there: for many
    short series, of which a task before the shuffle would cut next to nothing.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    newest = [F.desc_nulls_last("timestamp"), *[F.desc_nulls_last(name) for name in MEASURES]]
    threshold = int(bars.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    kept = bars if partitions is None else bars.repartition(partitions, "symbol", "timeframe")
    if limit > threshold and partitions is None:
        salt = F.pmod(F.xxhash64("timestamp", *MEASURES), F.lit(_SALTS))
        part = Window.partitionBy("symbol", "timeframe", "salt").orderBy(*newest)
        kept = (
            kept.withColumn("salt", salt)
            .withColumn("rank", F.row_number().over(part))
            .where(F.col("rank") <= limit)
            .drop("salt", "rank")
        )
    series = Window.partitionBy("symbol", "timeframe").orderBy(*newest)
    return (
        kept.withColumn("rank", F.row_number().over(series))
        .where(F.col("rank") <= limit)
        .drop("rank")
    )
