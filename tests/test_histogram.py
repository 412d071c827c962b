"""Bars per day, and what the newest bars need of the trades."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom import Timeframe, bar_histogram, bars, latest_from_trades, newest_bounds, newest_trades
from barloom.operators import histogram as module
from tests.fixtures import TRADE_SCHEMA, collected, golden_trades, plan_of

START = datetime(2024, 1, 1)


def series(symbol, days, per_day, first=0):
    return [
        (symbol, START + timedelta(days=first + d, minutes=1440 / per_day * i), float(d), 1.0)
        for d in range(days) for i in range(per_day)
    ]


@pytest.fixture(scope="module")
def many(spark):
    """Busy symbols over 60 days, two that stopped early, and one without a name."""
    rows = [r for k in range(6) for r in series(f"BUSY{k}", 60, 40)]
    rows += series("OLD", 10, 3) + series("RARE", 60, 1) + series(None, 20, 2, 5)
    return spark.createDataFrame(rows, TRADE_SCHEMA).repartition(6)


@pytest.mark.parametrize("frames", [
    ["1D", "4H", "1H", "15M", "5M"], ["5M"], [Timeframe("3H", "3h", 10_800), Timeframe("1W", "1w", 604_800)], [Timeframe("7M", "7m", 420)],
])
def test_counts_are_those_of_the_bars(spark, many, frames):
    trades = many.union(golden_trades(spark)).union(spark.createDataFrame([("N", None, 1.0, 1.0), ("N", START, None, 1.0)], TRADE_SCHEMA))
    counted = bar_histogram(trades, frames).collect()
    span = 86_400
    if any(isinstance(f, Timeframe) and f.seconds == 604_800 for f in frames):
        span = 604_800
    elif any(isinstance(f, Timeframe) and f.seconds == 420 for f in frames):
        span = 86_400 // 420 * 420
    expected = Counter()
    for r in bars(trades, frames).collect():
        seconds = int((r.timestamp - datetime(1970, 1, 1)).total_seconds())
        expected[r.symbol, r.timeframe, datetime(1970, 1, 1) + timedelta(seconds=seconds - seconds % span)] += 1
    assert {(r.symbol, r.timeframe, r.span): r.bars for r in counted} == expected


def test_bounds_hold_the_nth_newest_bar(spark, many):
    found = bars(many, ["1H", "5M"])
    since = {(r.symbol, r.timeframe): r.since for r in newest_bounds(bar_histogram(many, ["1H", "5M"]), 50).collect()}
    newest = latest_from_trades(many, timeframes=["1H", "5M"], limit=50).groupBy("symbol", "timeframe").agg(F.min("timestamp").alias("t"))
    for r in newest.collect():
        assert since[r.symbol, r.timeframe] == datetime(r.t.year, r.t.month, r.t.day)
    assert len(since) == found.select("symbol", "timeframe").distinct().count()


@pytest.mark.parametrize("limit", [1, 17, 50, 10_000])
@pytest.mark.parametrize("quiet", [100, 3, 1])
def test_rows_are_those_without_a_histogram(spark, many, monkeypatch, limit, quiet):
    monkeypatch.setattr(module, "QUIET_SYMBOLS", quiet)
    monkeypatch.setattr(module, "BOUNDS", 2)
    frames = ["4H", "5M"]
    counted = bar_histogram(many)
    plain = latest_from_trades(many, timeframes=frames, limit=limit)
    pruned = latest_from_trades(many, timeframes=frames, limit=limit, histogram=counted)
    assert collected(pruned) == collected(plain)
    some = latest_from_trades(many, ["OLD", "BUSY1"], frames, limit, histogram=counted)
    assert collected(some) == collected(latest_from_trades(many, ["OLD", "BUSY1"], frames, limit))


def test_later_trades_and_new_symbols_are_kept(spark, many):
    counted = bar_histogram(many)
    later = many.union(spark.createDataFrame(series("BUSY0", 9, 10, 60) + series("NEW", 4, 9, 60), TRADE_SCHEMA))
    found = latest_from_trades(later, limit=30, histogram=counted)
    assert collected(found) == collected(latest_from_trades(later, limit=30))


def test_zoned_times(spark, many, conf):
    conf("spark.sql.session.timeZone", "America/New_York")
    zoned = many.withColumn("ts", F.expr("timestamp_micros(unix_micros(cast(cast(ts as string) || ' UTC' as timestamp)))"))
    found = latest_from_trades(zoned, limit=20, histogram=bar_histogram(zoned))
    assert collected(found) == collected(latest_from_trades(zoned, limit=20)) != []


def test_empty_tables(spark, many):
    none = spark.createDataFrame([], TRADE_SCHEMA)
    assert bar_histogram(none).count() == 0
    assert latest_from_trades(none, histogram=bar_histogram(none)).count() == 0


def scanned(df):
    """Rows that the scan of the plan that ran has read."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        rows += leaves.apply(i).metrics().apply("numOutputRows").value()
    return rows


@pytest.fixture
def by_time(spark, tmp_path, conf):
    """40 symbols over 120 days, stored by time: zoned microseconds, and zone-less by day."""
    conf("spark.sql.maxMetadataStringLength", "2000")
    conf("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    rows = [r for k in range(40) for r in series(f"S{k}", 120, 24)] + series("OLD", 3, 2)
    df = spark.createDataFrame(rows, TRADE_SCHEMA).withColumn("day", F.col("ts").cast("date"))
    zoned = df.withColumn("ts", F.col("ts").cast("timestamp"))
    zoned.repartitionByRange(12, "ts").write.parquet(f"{tmp_path}/zoned")
    df.repartitionByRange(12, "ts").write.parquet(f"{tmp_path}/days")
    tables = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("zoned", "days")}
    bar_histogram(tables["days"], ["1H", "5M"]).write.parquet(f"{tmp_path}/histogram")
    return tables, spark.read.parquet(f"{tmp_path}/histogram"), len(rows)


@pytest.mark.parametrize("name, day, pushed", [
    ("zoned", None, "GreaterThanOrEqual(ts,2024-04-2"), ("days", "day", "GreaterThanOrEqual(day,2024-04-2"),
])
def test_a_time_filter_reaches_the_scan_and_reads_less(by_time, conf, name, day, pushed):
    tables, counted, count = by_time
    trades = tables[name]
    more = {"timeframes": ["1H", "5M"], "limit": 100}
    plan = plan_of(latest_from_trades(trades, histogram=counted, day=day, **more))
    assert pushed in plan and "EqualTo(symbol,OLD)" in plan
    found = collected(latest_from_trades(trades, histogram=counted, day=day, **more))
    assert found == collected(latest_from_trades(trades, **more))
    conf("spark.sql.adaptive.enabled", "false")
    assert scanned(trades) == count
    assert scanned(newest_trades(trades, counted, 100, ["1H", "5M"], day)) < 0.3 * count


def test_two_shuffles_of_reduced_rows_and_three_columns(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    trades = events.selectExpr("event_type as symbol", "ts", "value as price", "1.0D as size")
    plan = plan_of(bar_histogram(trades))
    assert plan.count("Exchange hashpartitioning") == 2 and "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
