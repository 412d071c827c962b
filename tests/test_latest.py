from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom import latest_bars
from barloom.sources.schemas import BAR_COLUMNS, BAR_SCHEMA
from tests.fixtures import collected

START = datetime(2024, 1, 1)


def series(symbol: str, timeframe: str, count: int, seed: int = 0) -> list[tuple]:
    stamps = [START + timedelta(minutes=5 * i) for i in range(count)]
    random.Random(seed).shuffle(stamps)
    return [(symbol, timeframe, ts, 1.0, 2.0, 0.5, 1.5, float(i)) for i, ts in enumerate(stamps)]


def newest(rows: list[tuple], limit: int) -> list[tuple]:
    groups: dict[tuple, list] = {}
    for row in rows:
        groups.setdefault(row[:2], []).append(row)
    kept = []
    for members in groups.values():
        kept += sorted(members, key=lambda row: row[2], reverse=True)[:limit]
    return sorted(kept, key=repr)


@pytest.mark.parametrize("limit", [1, 7, 500, 10_000])
def test_newest_per_series(spark, limit):
    rows = series("A", "5M", 900) + series("A", "1H", 5) + series("B", "5M", 501)
    df = spark.createDataFrame(rows, BAR_SCHEMA).repartition(8)
    assert collected(latest_bars(df, limit)) == newest(rows, limit)


@pytest.mark.parametrize("limit", [3, 20, 200])
def test_salted_ranking_is_exact(spark, conf, limit):
    conf("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    rows = series("HOT", "5M", 3_000) + series("B", "5M", 10) + series("B", "1D", 250)
    df = spark.createDataFrame(rows, BAR_SCHEMA).repartition(8)
    assert collected(latest_bars(df, limit)) == newest(rows, limit)


@pytest.mark.parametrize("threshold", ["1", "1000"])
def test_copies_are_kept_and_counted(spark, conf, threshold):
    conf("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    copies = spark.range(5_000).select(
        F.lit("A").alias("symbol"),
        F.lit("5M").alias("timeframe"),
        F.lit(START).cast("timestamp_ntz").alias("timestamp"),
        *[F.lit(1.0).alias(name) for name in BAR_COLUMNS[3:]],
    )
    assert latest_bars(copies, 120).count() == 120
    assert latest_bars(copies, 9_000).count() == 5_000


def test_equal_stamps_always_keep_the_same_rows(spark):
    rows = [("A", "5M", START, float(i), 1.0, 1.0, 1.0, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, BAR_SCHEMA)
    for parts in (1, 3, 8):
        kept = latest_bars(df.repartition(parts), 2).collect()
        assert {row.open for row in kept} == {49.0, 48.0}


def test_limit_must_be_positive(spark):
    with pytest.raises(ValueError):
        latest_bars(spark.createDataFrame([], BAR_SCHEMA), 0)
