from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom import epoch_ms_to_timestamp, timestamp_to_epoch_ms
from barloom.functions.timestamps import (
    bucket_start,
    epoch_us_to_timestamp,
    timestamp_to_epoch_us,
    to_utc_ntz,
)

EPOCH = datetime(1970, 1, 1)
# Around the epoch, a leap day, both New York clock changes of 2024, far ends.
MILLIS = [
    -62_135_596_800_000, -86_400_001, -1, 0, 1, 1_709_164_800_000, 1_710_037_800_123,
    1_710_041_399_999, 1_730_611_800_000, 1_730_615_400_000, 253_402_300_799_999,
]
ZONES = ["UTC", "America/New_York", "Asia/Kolkata"]


def expected(ms: int) -> datetime:
    return EPOCH + timedelta(milliseconds=ms)


@pytest.mark.parametrize("zone", ZONES)
def test_milliseconds_both_ways(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    df = spark.createDataFrame([(ms,) for ms in [*MILLIS, None]], "ms long")
    df = df.withColumn("ts", epoch_ms_to_timestamp(F.col("ms")))
    assert dict(df.dtypes)["ts"] == "timestamp_ntz"
    rows = df.withColumn("back", timestamp_to_epoch_ms(F.col("ts"))).collect()
    for row in rows:
        assert row.ts == (None if row.ms is None else expected(row.ms))
        assert row.back == row.ms


@pytest.mark.parametrize("zone", ZONES)
def test_milliseconds_arrive_as_doubles(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    df = spark.createDataFrame([(float(ms),) for ms in MILLIS], "ms double")
    rows = df.select(epoch_ms_to_timestamp(F.col("ms")).alias("ts")).collect()
    assert [row.ts for row in rows] == [expected(ms) for ms in MILLIS]


def test_milliseconds_round_down(spark):
    stamps = [EPOCH + timedelta(microseconds=us) for us in (-1, 999, 1_000, 1_999)]
    df = spark.createDataFrame([(ts,) for ts in stamps], "ts timestamp_ntz")
    rows = df.select(timestamp_to_epoch_ms(F.col("ts")).alias("ms")).collect()
    assert [row.ms for row in rows] == [-1, 0, 1, 1]


@pytest.mark.parametrize("zone", ZONES)
def test_microseconds_both_ways(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    df = spark.createDataFrame([(ms * 1_000 + 7,) for ms in MILLIS], "us long")
    df = df.withColumn("ts", epoch_us_to_timestamp(F.col("us")))
    for row in df.withColumn("back", timestamp_to_epoch_us(F.col("ts"))).collect():
        assert row.ts == EPOCH + timedelta(microseconds=row.us)
        assert row.back == row.us


@pytest.mark.parametrize("zone", ZONES)
def test_instants_to_utc(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    df = spark.createDataFrame([(ms,) for ms in MILLIS], "ms long")
    rows = df.select(to_utc_ntz(F.timestamp_millis("ms")).alias("ts")).collect()
    assert [row.ts for row in rows] == [expected(ms) for ms in MILLIS]


@pytest.mark.parametrize("zone", ZONES)
@pytest.mark.parametrize("seconds", [1, 7, 300, 86_400, 604_800])
def test_buckets_align_to_the_epoch(spark, conf, zone, seconds):
    conf("spark.sql.session.timeZone", zone)
    df = spark.createDataFrame([(expected(ms),) for ms in MILLIS[1:]], "ts timestamp_ntz")
    rows = df.select("ts", bucket_start(F.col("ts"), seconds).alias("start")).collect()
    assert len(rows) == len(MILLIS) - 1
    for row in rows:
        since = (row.ts - EPOCH) // timedelta(seconds=seconds)
        assert row.start == EPOCH + since * timedelta(seconds=seconds)
