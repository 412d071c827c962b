"""Hand-written trades with the bars they must give, and small helpers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from barloom.sources.schemas import BAR_SCHEMA

TRADE_SCHEMA = "symbol string, ts timestamp_ntz, price double, size double"

GOLDEN_TRADES = [
    ("2024-01-01 00:00:00", 10.0, 1.0),
    ("2024-01-01 00:04:59.999999", 12.0, 2.0),
    ("2024-01-01 00:05:00", 9.0, 3.0),
    ("2024-01-01 00:20:00", 11.0, 4.0),
    ("2024-01-01 03:59:59", 8.0, 5.0),
    ("2024-01-01 04:00:00", 15.0, 6.0),
    ("2024-01-02 00:00:00", 7.0, 7.0),
]

GOLDEN_BARS = [
    ("1D", "2024-01-01 00:00", 10, 15, 8, 15, 21),
    ("1D", "2024-01-02 00:00", 7, 7, 7, 7, 7),
    ("4H", "2024-01-01 00:00", 10, 12, 8, 8, 15),
    ("4H", "2024-01-01 04:00", 15, 15, 15, 15, 6),
    ("4H", "2024-01-02 00:00", 7, 7, 7, 7, 7),
    ("1H", "2024-01-01 00:00", 10, 12, 9, 11, 10),
    ("1H", "2024-01-01 03:00", 8, 8, 8, 8, 5),
    ("1H", "2024-01-01 04:00", 15, 15, 15, 15, 6),
    ("1H", "2024-01-02 00:00", 7, 7, 7, 7, 7),
    ("15M", "2024-01-01 00:00", 10, 12, 9, 9, 6),
    ("15M", "2024-01-01 00:15", 11, 11, 11, 11, 4),
    ("15M", "2024-01-01 03:45", 8, 8, 8, 8, 5),
    ("15M", "2024-01-01 04:00", 15, 15, 15, 15, 6),
    ("15M", "2024-01-02 00:00", 7, 7, 7, 7, 7),
    ("5M", "2024-01-01 00:00", 10, 12, 10, 12, 3),
    ("5M", "2024-01-01 00:05", 9, 9, 9, 9, 3),
    ("5M", "2024-01-01 00:20", 11, 11, 11, 11, 4),
    ("5M", "2024-01-01 03:55", 8, 8, 8, 8, 5),
    ("5M", "2024-01-01 04:00", 15, 15, 15, 15, 6),
    ("5M", "2024-01-02 00:00", 7, 7, 7, 7, 7),
]

GOLDEN_DOCUMENT_START = """\
# SYMBOL: AAABBB
# FORMAT: OHLCV
# TIMEFRAME: 1D
timestamp,open,high,low,close,volume
2024-01-01,10.0,15.0,8.0,15.0,21.0
2024-01-02,7.0,7.0,7.0,7.0,7.0

# TIMEFRAME: 4H
timestamp,open,high,low,close,volume
2024-01-01 00:00:00,10.0,12.0,8.0,8.0,15.0
2024-01-01 04:00:00,15.0,15.0,15.0,15.0,6.0
2024-01-02 00:00:00,7.0,7.0,7.0,7.0,7.0

"""


def stamp(text: str) -> datetime:
    return datetime.fromisoformat(text)


def trades(spark: SparkSession, rows, symbol: str = "AAA/BBB") -> DataFrame:
    data = [(symbol, stamp(ts), price, size) for ts, price, size in rows]
    return spark.createDataFrame(data, TRADE_SCHEMA)


def golden_trades(spark: SparkSession, symbol: str = "AAA/BBB") -> DataFrame:
    return trades(spark, GOLDEN_TRADES, symbol)


def golden_rows(symbol: str = "AAA/BBB") -> list[tuple]:
    return [
        (symbol, label, stamp(ts), *[float(value) for value in values])
        for label, ts, *values in GOLDEN_BARS
    ]


def bar_table(spark: SparkSession, rows) -> DataFrame:
    """Rows of symbol, timeframe, stamp text (or None) and five measures."""
    data = [(s, t, stamp(ts) if ts else None, *values) for s, t, ts, *values in rows]
    return spark.createDataFrame(data, BAR_SCHEMA)


def collected(df: DataFrame) -> list[tuple]:
    return sorted((tuple(row) for row in df.collect()), key=repr)


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
