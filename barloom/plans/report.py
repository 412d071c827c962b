"""Whole runs: from trades or landed raw bars to one document per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from barloom.functions.order_keys import PackedOrder
from barloom.functions.timeframes import TIMEFRAMES, Timeframe
from barloom.operators.bars import bars
from barloom.operators.histogram import newest_trades
from barloom.operators.latest import DEFAULT_LIMIT, latest_bars
from barloom.operators.naming import name_bars, newest_pulls
from barloom.operators.select import select_symbols, select_timeframes
from barloom.sinks.documents import write_documents


def latest_from_trades(
    trades: DataFrame,
    symbols: Sequence[str] | DataFrame | None = None,
    timeframes: Sequence[str | Timeframe] = TIMEFRAMES,
    limit: int = DEFAULT_LIMIT,
    order_by: str | Sequence[str] | PackedOrder = "ts",
    histogram: DataFrame | None = None,
    exact_volume: bool = False,
    day: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Newest bars of every symbol and timeframe, built from trades.

    With the trades' ``bar_histogram`` only trades are scanned that the newest bars may
    need; ``day`` names a column with the UTC date of ``ts``, see ``newest_trades``. For
    ``partitions`` see ``bars`` and ``latest_bars``.
    """
    if symbols is not None:
        trades = select_symbols(trades, symbols)
        histogram = histogram if histogram is None else select_symbols(histogram, symbols)
    if histogram is not None:
        trades = newest_trades(trades, histogram, limit, timeframes, day)
    return latest_bars(bars(trades, timeframes, order_by, exact_volume, partitions), limit, partitions)


def latest_from_raw(
    raw: DataFrame,
    symbols: Sequence[str] | None = None,
    timeframes: Sequence[str | Timeframe] = TIMEFRAMES,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Newest bars of every symbol and timeframe, from landed raw bars.

    Overlapping pulls count once: the later pull's bar stays.
    """
    if symbols is not None:
        raw = select_symbols(raw, symbols)
    named = name_bars(select_timeframes(raw, timeframes), keep_pulled=True)
    return latest_bars(newest_pulls(named), limit)


def report_from_trades(
    trades: DataFrame,
    path: str,
    symbols: Sequence[str] | None = None,
    timeframes: Sequence[str | Timeframe] = TIMEFRAMES,
    limit: int = DEFAULT_LIMIT,
    order_by: str | Sequence[str] | PackedOrder = "ts",
    footer_lines: Sequence[str] = (),
) -> None:
    """Write a document per symbol from trades, reading them once."""
    if symbols is not None:
        trades = select_symbols(trades, symbols)
    built = bars(trades, timeframes, order_by)
    write_documents(built, path, timeframes, limit, symbols, footer_lines)


def report_from_raw(
    raw: DataFrame,
    path: str,
    symbols: Sequence[str] | None = None,
    timeframes: Sequence[str | Timeframe] = TIMEFRAMES,
    limit: int = DEFAULT_LIMIT,
    footer_lines: Sequence[str] = (),
) -> None:
    """Write a document per symbol from landed raw bars, reading them once."""
    if symbols is not None:
        raw = select_symbols(raw, symbols)
    named = name_bars(select_timeframes(raw, timeframes), keep_empty=True, keep_pulled=True)
    write_documents(newest_pulls(named), path, timeframes, limit, symbols, footer_lines)
