"""How many bars each series has over time, and which trades the newest ones need."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from barloom.functions.timeframes import TIMEFRAMES, Timeframe, resolve
from barloom.functions.timestamps import bucket_start, epoch_us_to_timestamp, timestamp_to_epoch_us, to_utc_ntz
from barloom.scratch import stored

DAY = 86_400
QUIET_SYMBOLS = 100  # symbols that a filter names one by one, with bounds of their own
BOUNDS = 8  # different bounds among those
_MOST_BASE_BARS = 1_000  # of one symbol and span brought together uncombined


def bar_histogram(trades: DataFrame, timeframes: Sequence[str | Timeframe] = TIMEFRAMES) -> DataFrame:
    """Rows ``symbol, timeframe, span, bars``: the bars that start in each span of time.

    A span is a day, or the shortest time of at least about a day that all timeframes
    divide. Only ``symbol``, ``ts`` and whether there is a price are read. Each task
    reduces its trades to one row per symbol and shortest interval before the first shuffle;
    the rows of a symbol and span then meet once, and the counts need no further shuffle.

    Keep the result as a table next to the trades: it is small, and ``newest_trades`` reads
    it in place of old trades. Trades that arrive later only make its bounds too early,
    which is safe; after deletions it must be made again.
    """
    frames = resolve(timeframes)
    base = math.gcd(*[frame.seconds for frame in frames])
    common = math.lcm(*[frame.seconds for frame in frames])
    span = common * max(1, DAY // common)
    start = bucket_start(F.col("ts"), base)
    if isinstance(trades.schema["ts"].dataType, TimestampType):
        start = to_utc_ntz(start)
    met = trades.where(F.col("price").isNotNull() & F.col("ts").isNotNull()).select("symbol", start.alias("start")).distinct()
    rows = met.select("symbol", timestamp_to_epoch_us(F.col("start")).alias("at")).withColumn("span", _floor(span))
    if span // base <= _MOST_BASE_BARS:
        rows = rows.repartition("symbol", "span")
    targets = F.array(*[F.struct(F.lit(i).alias("section"), _floor(f.seconds).alias("bar")) for i, f in enumerate(frames)])
    labels = F.array(*[F.lit(frame.label) for frame in frames])
    return (
        rows.select("symbol", "span", F.inline(targets)).distinct()
        .groupBy("symbol", "span", "section").agg(F.count("*").alias("bars"))
        .select("symbol", F.get(labels, F.col("section")).alias("timeframe"), epoch_us_to_timestamp(F.col("span")).alias("span"), "bars")
    )


def newest_bounds(histogram: DataFrame, limit: int) -> DataFrame:
    """For each symbol and timeframe the start of the span that holds its ``limit``-th newest bar.

    A series of fewer bars is needed from its first span on. A series has one row for each
    of its spans, so the running sum sees days and not trades.
    """
    newer = Window.partitionBy("symbol", "timeframe").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    counted = histogram.withColumn("newer", F.coalesce(F.sum("bars").over(newer), F.lit(0)))
    return counted.where(F.col("newer") < limit).groupBy("symbol", "timeframe").agg(F.min("span").alias("since"))


def newest_trades(
    trades: DataFrame,
    histogram: DataFrame,
    limit: int,
    timeframes: Sequence[str | Timeframe] = TIMEFRAMES,
    day: str | None = None,
) -> DataFrame:
    """The trades that the newest ``limit`` bars of every series may need, and few others.

    The bounds become one filter of constants on ``ts`` and ``symbol``, which goes to the
    scan: files and row groups of older trades are never read. It names the
    ``QUIET_SYMBOLS`` symbols whose bounds are earliest, and asks all others for trades
    from the next bound on; so a few symbols that hardly trade do not hold up the rest. The
    driver sees those symbols and bounds, never more.

    Spark skips Parquet row groups by zoned times stored as microseconds, and by dates, but
    neither by zone-less times nor by the older 96-bit form. For tables of those name a
    column ``day``, the UTC date of ``ts``, which gets the same bounds. As a partition column
    it prunes to the earliest bound only, as partitions do not tell symbols apart.
    """
    wanted = histogram.where(F.col("timeframe").isin([frame.label for frame in resolve(timeframes)]))
    bounds = newest_bounds(wanted, limit).groupBy("symbol").agg(F.min("since").alias("since"))
    earliest = stored(bounds, "bounds").orderBy("since", "symbol").limit(QUIET_SYMBOLS + 1).collect()
    if not earliest:
        return trades
    zoned = isinstance(trades.schema["ts"].dataType, TimestampType)

    def since(bound) -> Column:
        micros = timestamp_to_epoch_us(F.lit(bound).cast("timestamp_ntz"))
        at = F.timestamp_micros(micros) if zoned else epoch_us_to_timestamp(micros)
        later = F.col("ts") >= at
        return later if day is None else later & (F.col(day) >= F.lit(bound.date()))

    cut = earliest[-1].since
    by_bound: dict = {}
    for row in earliest:
        if row.since < cut:
            by_bound.setdefault(row.since, []).append(row.symbol)
    starts = sorted(by_bound)
    size = -(-len(starts) // BOUNDS) or 1
    needed = since(cut)
    for i in range(0, len(starts), size):
        symbols = reduce(list.__add__, [by_bound[s] for s in starts[i : i + size]])
        named = F.col("symbol").isin([s for s in symbols if s is not None])
        needed = needed | (since(starts[i]) & (named | F.col("symbol").isNull() if None in symbols else named))
    return trades.where(needed)


def _floor(seconds: int) -> Column:
    return F.expr(f"at - pmod(at, {seconds * 1_000_000}L)")
