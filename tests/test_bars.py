from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import TIMEFRAMES, Timeframe, bars, latest_bars, latest_from_trades, roll_up
from tests.fixtures import (
    TRADE_SCHEMA,
    collected,
    golden_rows,
    golden_trades,
    stamp,
    trades,
)

EPOCH = datetime(1970, 1, 1)


def brute_force(rows, frames) -> list[tuple]:
    """Bars one trade at a time; rows are symbol, time, price, size."""
    groups: dict[tuple, list] = {}
    for symbol, ts, price, size in sorted(rows, key=lambda row: row[1]):
        micros = (ts - EPOCH) // timedelta(microseconds=1)
        for frame in frames:
            length = frame.seconds * 1_000_000
            start = EPOCH + timedelta(microseconds=micros - micros % length)
            groups.setdefault((symbol, frame.label, start), []).append((price, size))
    return sorted(
        (
            (
                *key,
                members[0][0],
                max(price for price, _ in members),
                min(price for price, _ in members),
                members[-1][0],
                sum(size for _, size in members),
            )
            for key, members in groups.items()
        ),
        key=repr,
    )


def random_trades(seed: int, count: int, symbols: list[str], days: int) -> list[tuple]:
    """Distinct times, a few before 1970, whole sizes; a third on the first symbol."""
    rng = random.Random(seed)
    start = datetime(1969, 12, 31)
    micros = rng.sample(range(days * 86_400_000_000), count)
    return [
        (
            symbols[0] if rng.random() < 1 / 3 else rng.choice(symbols),
            start + timedelta(microseconds=value),
            round(rng.uniform(0.0001, 500), 4),
            float(rng.randint(0, 99)),
        )
        for value in micros
    ]


def test_golden_bars(spark):
    assert collected(bars(golden_trades(spark))) == sorted(golden_rows(), key=repr)


def test_golden_latest_two(spark):
    kept = latest_bars(bars(golden_trades(spark)), 2)
    expected = []
    for frame in TIMEFRAMES:
        expected += [row for row in golden_rows() if row[1] == frame.label][-2:]
    assert collected(kept) == sorted(expected, key=repr)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_session_zone_does_not_matter(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    # 02:30 on this day does not exist in New York.
    rows = [("2024-03-10 02:30:00.5", 1.0, 1.0), ("2024-03-10 03:30:00", 2.0, 1.0)]
    built = bars(trades(spark, rows), ["1H", "5M"])
    starts = {(row.timeframe, row.timestamp) for row in built.collect()}
    assert starts == {
        ("1H", stamp("2024-03-10 02:00")),
        ("1H", stamp("2024-03-10 03:00")),
        ("5M", stamp("2024-03-10 02:30")),
        ("5M", stamp("2024-03-10 03:30")),
    }


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zoned_trades_give_utc_bars(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    instants = spark.range(3).select(
        F.lit("X").alias("symbol"),
        F.timestamp_seconds(F.lit(1_710_037_800) + F.col("id") * 3600).alias("ts"),
        F.col("id").cast("double").alias("price"),
        F.lit(1.0).alias("size"),
    )
    built = bars(instants, ["1H"])
    assert dict(built.dtypes)["timestamp"] == "timestamp_ntz"
    assert sorted(row.timestamp for row in built.collect()) == [
        stamp("2024-03-10 02:00"),
        stamp("2024-03-10 03:00"),
        stamp("2024-03-10 04:00"),
    ]


def test_matches_brute_force_with_a_hot_symbol(spark):
    rows = random_trades(7, 6_000, [f"S{i}" for i in range(12)], 3)
    built = bars(spark.createDataFrame(rows, TRADE_SCHEMA).repartition(8))
    assert collected(built) == brute_force(rows, TIMEFRAMES)


@pytest.mark.parametrize(
    "frames",
    [
        [Timeframe("3H", "3h", 10_800), Timeframe("2H", "2h", 7_200)],  # not nested
        [Timeframe("7S", "7s", 7), Timeframe("1D", "1d", 86_400)],  # common interval 1 s
        [Timeframe("1W", "1w", 604_800), TIMEFRAMES[0], TIMEFRAMES[2]],
    ],
)
def test_other_timeframe_sets(spark, frames):
    rows = random_trades(11, 500, ["A", "B"], 20)
    built = bars(spark.createDataFrame(rows, TRADE_SCHEMA), frames)
    assert collected(built) == brute_force(rows, frames)


def test_one_hot_interval(spark):
    start = stamp("2024-01-01 00:00")
    rows = [("HOT", start + timedelta(microseconds=i), float(i), 1.0) for i in range(20_000)]
    built = bars(spark.createDataFrame(rows, TRADE_SCHEMA).repartition(16))
    for row in built.collect():
        assert (row.open, row.high, row.low, row.close, row.volume) == (0, 19_999, 0, 19_999, 20_000)


def test_invariants(spark):
    rows = random_trades(3, 3_000, ["A", "B", "C"], 5)
    built = bars(spark.createDataFrame(rows, TRADE_SCHEMA)).toPandas()
    assert (built.low <= built[["open", "close"]].min(axis=1)).all()
    assert (built.high >= built[["open", "close"]].max(axis=1)).all()
    volumes = built.groupby(["symbol", "timeframe"]).volume.sum().unstack()
    assert (volumes.nunique(axis=1) == 1).all()
    assert not built.duplicated(["symbol", "timeframe", "timestamp"]).any()


def test_roll_up_equals_direct(spark):
    rows = random_trades(5, 3_000, ["A", "B", "C"], 5)
    df = spark.createDataFrame(rows, TRADE_SCHEMA)
    base = bars(df, ["5M"])
    assert collected(roll_up(base)) == collected(bars(df))
    hourly = bars(df, ["1H"])
    assert collected(roll_up(hourly, ["1D", "4H"], base="1H")) == collected(bars(df, ["1D", "4H"]))


def test_roll_up_needs_whole_multiples(spark):
    with pytest.raises(ValueError, match="15M is not a whole multiple of 4H"):
        roll_up(bars(golden_trades(spark), ["4H"]), ["1D", "15M"], base="4H")


@pytest.mark.parametrize("order_by", ["trade_id", ("ts", "trade_id")])
def test_equal_stamps_are_ordered_by_a_second_column(spark, order_by):
    day = stamp("2024-01-01 00:00")
    rows = [("A", day, float(price), 1.0, price) for price in (5, 3, 9, 1, 7)]
    df = spark.createDataFrame(rows, TRADE_SCHEMA + ", trade_id long").repartition(4)
    for row in bars(df, order_by=order_by).collect():
        assert (row.open, row.close) == (1.0, 9.0)


def test_two_order_columns_put_time_first(spark):
    rows = [
        ("A", stamp("2024-01-01 00:00:02"), 2.0, 1.0, 1),
        ("A", stamp("2024-01-01 00:00:01"), 1.0, 1.0, 2),
    ]
    df = spark.createDataFrame(rows, TRADE_SCHEMA + ", trade_id long")
    (row,) = bars(df, ["5M"], order_by=("ts", "trade_id")).collect()
    assert (row.open, row.close) == (1.0, 2.0)


def test_rows_without_price_or_time_are_not_trades(spark):
    rows = [
        ("A", stamp("2024-01-01"), None, 1.0),
        ("A", None, 1.0, 1.0),
        ("A", stamp("2024-01-01 00:00:01"), 4.0, None),
    ]
    (row,) = bars(spark.createDataFrame(rows, TRADE_SCHEMA), ["1D"]).collect()
    assert tuple(row)[3:] == (4.0, 4.0, 4.0, 4.0, None)


def test_no_trades_give_no_bars(spark):
    empty = spark.createDataFrame([], TRADE_SCHEMA)
    assert bars(empty).collect() == []
    assert bars(empty).dtypes == bars(golden_trades(spark)).dtypes


def test_gaps_stay_gaps(spark):
    built = bars(golden_trades(spark), ["5M"]).toPandas()
    assert len(built) == 6
    assert pd.Timestamp("2024-01-01 00:10") not in set(built.timestamp)


@pytest.mark.parametrize("bad", [[], ["1D", "1D"], ["1M"], [Timeframe("X", "x", 0)]])
def test_bad_timeframes_are_refused(spark, bad):
    with pytest.raises(ValueError):
        bars(golden_trades(spark), bad)


def test_roll_up_skips_null_cells(spark):
    rows = [
        ("A", "2024-01-01 00:00", None, None, None, None, None),
        ("A", "2024-01-01 00:05", 2.0, 3.0, 1.0, 2.5, 4.0),
        ("A", "2024-01-01 00:10", None, 9.0, None, None, None),
        ("B", "2024-01-01 00:00", None, None, None, None, None),
    ]
    schema = "symbol string, timestamp string, open double, high double, low double, close double, volume double"
    base = spark.createDataFrame(rows, schema).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    rolled = {row.symbol: tuple(row)[3:] for row in roll_up(base, ["1H"]).collect()}
    assert rolled == {"A": (2.0, 9.0, 1.0, 2.5, 4.0), "B": (None,) * 5}


def test_wide_sets_give_the_same_bars(spark, monkeypatch):
    trades = spark.createDataFrame(random_trades(5, 3_000, ["A", "B"], 3), TRADE_SCHEMA)
    expected = collected(bars(trades))
    monkeypatch.setattr("barloom.operators.bars._MOST_BASE_BARS", 10)
    assert collected(bars(trades)) == expected


@pytest.mark.parametrize("frames", [["1D"], ["1D", "1H", "5M"], [Timeframe("3H", "3h", 10_800), Timeframe("2H", "2h", 7_200)]])
@pytest.mark.parametrize("zoned", [False, True])
def test_dealt_trades_give_the_same_bars(spark, frames, zoned):
    trades = spark.range(4_000).select(
        F.concat(F.lit("S"), (F.col("id") % 7).cast("string")).alias("symbol"),
        F.timestamp_add("SECOND", (F.col("id") * 397).cast("int"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("ts"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 101).cast("double")).alias("price"),
        (F.col("id") % 13).cast("double").alias("size"),
    )
    if zoned:
        trades = trades.withColumn("ts", F.col("ts").cast("timestamp"))
    for exact in (False, True):
        plain = latest_from_trades(trades, timeframes=frames, limit=20, exact_volume=exact)
        dealt = latest_from_trades(trades, timeframes=frames, limit=20, exact_volume=exact, partitions=5)
        assert collected(dealt) == collected(plain) and dealt.schema == plain.schema
