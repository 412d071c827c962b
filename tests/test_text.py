from __future__ import annotations

import math
import random
import struct

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom import clean_symbol, document_name, number_text, stamp_text
from tests.fixtures import stamp


def texts(spark, numbers):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    rows = df.select("i", number_text(F.col("x")).alias("t")).orderBy("i").collect()
    return [row.t for row in rows]


def test_numbers_print_like_a_data_frame(spark):
    numbers = [
        0.0, -0.0, 1.0, 12.5, 9999999.999, 1e7, 12345678.0, -12345678.9, 123456789012345.6, 1e15,
        1e16, 1.2e22, 1e100, 1e-3, 9.99e-4, 1e-4, 0.00012345678901234567, 1e-5, -1.5e-7, -1e-300,
        math.inf, -math.inf,
    ]
    assert texts(spark, numbers) == [repr(x) for x in numbers]


def test_missing_numbers_have_no_text(spark):
    assert texts(spark, [None, math.nan]) == [None, None]


def test_every_number_reads_back_equal(spark):
    rng = random.Random(4)
    numbers = []
    while len(numbers) < 5_000:
        (x,) = struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))
        if math.isfinite(x):
            numbers.append(x)
    assert [float(text) for text in texts(spark, numbers)] == numbers


def test_rounded_numbers_print_exactly(spark):
    rng = random.Random(5)
    numbers = [
        round(rng.random() * 10 ** rng.randint(-6, 12), rng.randint(0, 10)) for _ in range(5_000)
    ]
    assert texts(spark, numbers) == [repr(x) for x in numbers]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=200))
def test_any_numbers_read_back_equal(spark, numbers):
    assert [float(text) for text in texts(spark, numbers)] == numbers


def test_symbols(spark):
    df = spark.createDataFrame([("AAA/BBB",), ("A/B/C",), ("/",), ("PLAIN",), (None,)], "s string")
    rows = df.select(clean_symbol(F.col("s")), document_name(F.col("s"))).collect()
    assert [tuple(row) for row in rows] == [
        ("AAABBB", "AAABBB_MTF_OHLCV.csv"),
        ("ABC", "ABC_MTF_OHLCV.csv"),
        ("", "_MTF_OHLCV.csv"),
        ("PLAIN", "PLAIN_MTF_OHLCV.csv"),
        (None, None),
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize(
    "stamps",
    [
        ["2024-01-01", "2024-01-02"],
        ["2024-01-01", "2024-01-02 04:00"],
        ["2024-03-10 02:30", "2024-01-02 00:00"],
        ["2024-01-01", "2024-01-02 00:00:00.120"],
        ["2024-01-01 00:00:00.000001", "2024-01-02 00:00:00.120"],
        ["2024-01-01", None],
        ["2024-01-01 01:00", None],
        ["1969-12-31 23:59:59.5"],
    ],
)
def test_stamps_print_like_a_data_frame(spark, conf, zone, stamps):
    conf("spark.sql.session.timeZone", zone)
    rows = [("A", stamp(text) if text else None) for text in stamps] + [("B", stamp("2024-01-01"))]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz")
    printed = df.select("s", "ts", stamp_text(F.col("ts"), "s").alias("t")).where("s = 'A'")
    frame = pd.DataFrame({"ts": pd.to_datetime([row[1] for row in rows[:-1]])})
    lines = frame.to_csv(index=False).split("\n")[1:-1]
    expected = [line.strip('"') for line in lines]
    assert sorted(row.t or "" for row in printed.collect()) == sorted(expected)
