"""Scan of landed raw bars: nested positional rows, one record per pull."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.timeframes import Timeframe, resolve
from barloom.operators.select import select_symbols, select_timeframes
from barloom.sources.schemas import BAR_FIELDS, RAW_BAR_SCHEMA


def read_raw_bars(
    spark: SparkSession,
    path: str | list[str],
    symbols: Sequence[str] | None = None,
    timeframes: Sequence[str | Timeframe] | None = None,
    fmt: str = "json",
) -> DataFrame:
    """Read raw bars landed as JSON lines (or Parquet) with a fixed schema.

    Both filters reach the scan. A malformed record fails the job; it is not
    turned into nulls.
    """
    reader = spark.read.schema(RAW_BAR_SCHEMA)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    raw = reader.format(fmt).load(path)
    if symbols is not None:
        raw = select_symbols(raw, symbols)
    if timeframes is not None:
        raw = select_timeframes(raw, timeframes)
    return raw


_PARSED = RAW_BAR_SCHEMA + ", broken string"


def read_raw_lines(
    spark: SparkSession,
    path: str | list[str],
    symbols: Sequence[str] | None = None,
    timeframes: Sequence[str | Timeframe] | None = None,
) -> DataFrame:
    """Raw bars of JSON lines with what is wrong with them, in place of a failing job.

    Each line gives one row: the raw columns, the ``record`` as it stands, and ``reason``,
    null for a record that can be read. Bars of more than six values move from ``ohlcv``
    to ``too_long``. Take the good part with ``good_raw`` and the rest with ``raw_rejects``;
    both read the lines in one pass without a shuffle. Blank lines are no records. Filters
    on symbols and timeframes apply to records that can be read: rejected ones all stay.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    parsed = lines.select("value", F.from_json("value", _PARSED, options).alias("raw"))
    reason = (
        F.when(F.col("raw.broken").isNotNull() | F.col("raw").isNull(), "not a raw bar record")
        .when(F.col("raw.symbol").isNull(), "no symbol")
        .when(F.col("raw.timeframe").isNull(), "no timeframe")
    )
    rows = parsed.select(
        "raw.symbol", "raw.timeframe",
        F.expr(f"filter(raw.ohlcv, bar -> bar is null or size(bar) <= {len(BAR_FIELDS)})").alias("ohlcv"),
        "raw.pulled_at",
        F.expr(f"filter(raw.ohlcv, bar -> size(bar) > {len(BAR_FIELDS)})").alias("too_long"),
        F.col("value").alias("record"), reason.alias("reason"),
    )
    rejected = F.col("reason").isNotNull()
    if symbols is not None:
        rows = rows.where(rejected | F.col("symbol").isin(list(symbols)))
    if timeframes is not None:
        rows = rows.where(rejected | F.col("timeframe").isin([frame.label for frame in resolve(timeframes)]))
    return rows


def good_raw(lines: DataFrame) -> DataFrame:
    """The raw bars of ``read_raw_lines`` that ``name_bars`` can take."""
    return lines.where("reason is null").select("symbol", "timeframe", "ohlcv", "pulled_at")


def raw_rejects(lines: DataFrame) -> DataFrame:
    """``record`` and ``reason`` of every line, and of every single bar, that was left out.

    A line with a bar too long keeps its other bars; the record is then
    that bar with its symbol and timeframe.
    """
    whole = lines.where("reason is not null").select("record", "reason")
    bar = F.to_json(F.struct("symbol", "timeframe", F.col("bar").alias("ohlcv")))
    values = F.concat(F.lit("a bar of "), F.size("bar"), F.lit(" values"))
    single = lines.where("reason is null").select("symbol", "timeframe", F.explode("too_long").alias("bar"))
    return whole.unionByName(single.select(bar.alias("record"), values.alias("reason")))
