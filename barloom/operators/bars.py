"""Trades to open/high/low/close/volume bars at several timeframes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from barloom.functions.exact_sums import limb_names, limb_sums, with_total
from barloom.functions.order_keys import PackedOrder
from barloom.functions.timeframes import TIMEFRAMES, Timeframe, resolve
from barloom.functions.timestamps import (
    bucket_start,
    epoch_us_to_timestamp,
    timestamp_to_epoch_us,
    to_utc_ntz,
)
from barloom.sources.schemas import MEASURES


_MOST_BASE_BARS = 1_000  # of one symbol and longest interval brought together uncombined
_TRADES_A_TASK = 250_000


def partitions_for(trades: DataFrame, rows: int = _TRADES_A_TASK) -> int:
    """So many partitions that one holds about ``rows`` trades: counts them, reading no column of a file."""
    return max(-(-trades.count() // rows), trades.sparkSession.sparkContext.defaultParallelism)


def bars(
    trades: DataFrame,
    timeframes: Sequence[str | Timeframe] = TIMEFRAMES,
    order_by: str | Sequence[str] | PackedOrder = "ts",
    exact_volume: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Build one bar per symbol, timeframe and interval that saw a trade.

    ``trades`` has ``symbol, ts, price, size``; intervals are aligned to the UTC
    epoch and gaps stay gaps. A row without a price or a time is no trade: it
    forms no bar and its size is not counted. ``order_by`` says which trade in an interval is
    first and last. It must be unique within a symbol for a repeatable open and
    close: keep ``ts`` if it is, name a rising trade number if there is one (one
    plain column keeps the aggregate hash-based), or pass both,
    ``("ts", "trade_id")`` (correct but sort-based), or a ``PackedOrder`` of columns
    with declared ranges (correct and hash-based).

    With ``exact_volume`` the volume is the exact sum, rounded once, and so has the same
    bits however the trades are partitioned; see ``functions.exact_sums`` for its range.

    Trades are read and shuffled once, as bars of the greatest common interval:
    every task reduces its rows to one per symbol and interval first, so a hot
    symbol or a hot interval adds at most one row per task to the shuffle. The
    longer bars are then rolled up from those.

    That reduction is in vain where an interval holds about one trade, and then every task
    keeps nearly all its trades in memory. For such trades name ``partitions`` (see
    ``partitions_for``): they are dealt by symbol and longest interval over so many tasks,
    which fold them and roll them up where they are. A task then holds its share of the
    trades, whatever the size of a file split or the number of shuffle partitions.
    """
    frames = resolve(timeframes)
    base = Timeframe("base", "base", math.gcd(*[frame.seconds for frame in frames]))
    dealt = None
    if partitions is not None:
        longest = max(frame.seconds for frame in frames)
        dealt = (partitions, longest if _is_nested(frames, base) else base.seconds)
    base_bars = _base_bars(trades, base.seconds, order_by, exact_volume, dealt)
    if len(frames) == 1:
        if exact_volume:
            base_bars = with_total(base_bars, "volume")
        return base_bars.select(
            "symbol", F.lit(frames[0].label).alias("timeframe"), "timestamp", *MEASURES
        )
    return _rolled_up(base_bars, frames, base, exact_volume, dealt is not None)


def _base_bars(
    trades: DataFrame,
    seconds: int,
    order_by: str | Sequence[str] | PackedOrder,
    exact_volume: bool,
    dealt: tuple[int, int] | None = None,
) -> DataFrame:
    """``dealt``: partitions, and seconds of the intervals dealt to them, kept as ``span``."""
    # A zoned column is bucketed as the instant it is; only the few bar starts
    # are turned into zone-less UTC, after the aggregation.
    zoned = isinstance(trades.schema["ts"].dataType, TimestampType)
    start = F.col("start")
    rows = trades.where(F.col("price").isNotNull()).withColumn("start", bucket_start(F.col("ts"), seconds))
    keys = ["symbol", "start"]
    if dealt:
        rows = rows.withColumn("span", bucket_start(F.col("start"), dealt[1]))
        keys.insert(1, "span")
    if isinstance(order_by, PackedOrder):
        # Read twice, so worked out once in a column of its own.
        rows = rows.select(*keys, "price", "size", order_by.column(seconds).alias("packed_order"))
        order = "packed_order"
    else:
        orders = [f"`{key}`" for key in ([order_by] if isinstance(order_by, str) else order_by)]
        order = orders[0] if len(orders) == 1 else f"struct({', '.join(orders)})"
    if dealt:
        rows = rows.repartition(dealt[0], "symbol", "span")
    volumes = limb_sums("volume", "size") if exact_volume else [_volume("size")]
    return (
        rows.groupBy(*keys)
        .agg(*_prices("price", "price", "price", "price", order, order), *volumes)
        .select(*keys[:-1], (to_utc_ntz(start) if zoned else start).alias("timestamp"), *_PRICES, *_volumes(exact_volume))
    )


def roll_up(
    base_bars: DataFrame,
    timeframes: Sequence[str | Timeframe] = TIMEFRAMES,
    base: str | Timeframe = "5M",
) -> DataFrame:
    """Build longer bars from bars of one shorter timeframe.

    Every target must be a whole multiple of the base. Volumes are added up;
    open and close come from the earliest and latest base bar that has one.
    Null cells are skipped, so a bar is null only where all its base bars are.
    """
    (base,) = resolve([base])
    return _rolled_up(base_bars, resolve(timeframes), base, False)


def _rolled_up(
    base_bars: DataFrame, frames: Sequence[Timeframe], base: Timeframe, exact_volume: bool, dealt: bool = False
) -> DataFrame:
    """Base bars of limb sums in place of volumes are added up exactly; ``dealt`` ones lie by ``span``."""
    for frame in frames:
        if frame.seconds % base.seconds:
            raise ValueError(f"{frame.label} is not a whole multiple of {base.label}")

    # When all targets nest inside the longest one, bring the base bars of one
    # symbol and one longest interval together: a group of at most
    # longest / base rows, however many trades lie behind them. The shuffle
    # then moves each base bar once, and not once per timeframe.
    # Sets that span more than that are combined in each task before the
    # shuffle instead, so no task ever holds a whole longest interval.
    longest = max(frame.seconds for frame in frames)
    nested = _is_nested(frames, base)
    at = timestamp_to_epoch_us(F.col("timestamp"))
    keys = ["symbol", "section", "start"]
    kept = ["symbol", *_PRICES, *_volumes(exact_volume)]
    if nested:
        keys.insert(1, "span")
    if nested and dealt:
        kept.insert(1, "span")
    rows = base_bars.select(*kept, at.alias("at"))
    if nested and not dealt:
        rows = rows.withColumn("span", F.expr(_floor(longest))).repartition("symbol", "span")
    # Numbers as keys: hashing a label per row would cost more than the rest.
    targets = ", ".join(
        f"struct({i} as section, {_floor(frame.seconds)} as start)"
        for i, frame in enumerate(frames)
    )
    labels = F.array(*[F.lit(frame.label) for frame in frames])
    volumes = limb_sums("volume") if exact_volume else [_volume("volume")]
    built = (
        rows.select("*", F.expr(f"inline(array({targets}))"))
        .groupBy(*keys)
        .agg(*_prices("open", "high", "low", "close", _AT_OPEN, _AT_CLOSE), *volumes)
        .select(
            "symbol",
            F.get(labels, F.col("section")).alias("timeframe"),
            epoch_us_to_timestamp(F.col("start")).alias("timestamp"),
            *_PRICES,
            *_volumes(exact_volume),
        )
    )
    return with_total(built, "volume") if exact_volume else built


def _is_nested(frames: Sequence[Timeframe], base: Timeframe) -> bool:
    longest = max(frame.seconds for frame in frames)
    return longest // base.seconds <= _MOST_BASE_BARS and all(longest % frame.seconds == 0 for frame in frames)


# A null order leaves a row out, and stays a long: the aggregate is still hash-based.
_AT_OPEN = "if(open is null, null, at)"
_AT_CLOSE = "if(close is null, null, at)"


_PRICES = MEASURES[:-1]


def _volumes(exact: bool) -> list[str]:
    return limb_names("volume") if exact else ["volume"]


def _volume(sizes: str) -> Column:
    return F.expr(f"sum({sizes}) as volume")


def _prices(opens: str, highs: str, lows: str, closes: str, first: str, last: str) -> list[Column]:
    return [
        F.expr(f"min_by({opens}, {first}) as open"),
        F.expr(f"max({highs}) as high"),
        F.expr(f"min({lows}) as low"),
        F.expr(f"max_by({closes}, {last}) as close"),
    ]


def _floor(seconds: int) -> str:
    return f"at - pmod(at, {seconds * 1_000_000}L)"
