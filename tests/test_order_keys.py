"""Packed order keys: the order of a struct, declared ranges checked, hash aggregates."""

from __future__ import annotations

import random

import pytest

import __spark_entry__ as driver
from barloom import OrderField, PackedOrder, bars
from tests.fixtures import TRADE_SCHEMA, collected, plan_of, stamp

SCHEMA = TRADE_SCHEMA + ", trade long, part int, cents double"


def rows(count, seed=0):
    chance = random.Random(seed)
    return [
        ("AB"[i % 2], stamp(f"2024-01-0{chance.randint(1, 4)} {chance.choice(['00:00:00', '13:20:05', '13:20:05.000001'])}"),
         float(i), 1.0, chance.randint(-3, 3), chance.randint(0, 2), chance.randint(0, 20) / 4)
        for i in range(count)
    ]


def fields(wide=1):
    return [OrderField("trade", -3, 3 * wide), OrderField("part", 0, 2), OrderField("cents", 0, 5, scale=4), OrderField("price", 0, 1000)]


@pytest.mark.parametrize("wide", [1, 10**15])
@pytest.mark.parametrize("frames", [["1D", "1H"], ["5M"]])
def test_the_order_is_that_of_the_columns(spark, wide, frames):
    df = spark.createDataFrame(rows(400), SCHEMA)
    expected = bars(df, frames, order_by=("ts", "trade", "part", "cents", "price"))
    found = bars(df, frames, order_by=PackedOrder(fields(wide)))
    assert collected(found) == collected(expected)
    plan = plan_of(found)
    assert "SortAggregate" not in plan and ("decimal(38,0)" in plan) == (wide > 1)


def test_whole_steps_take_less_room(spark):
    whole = [r for r in rows(200) if r[1].hour == 0]
    df = spark.createDataFrame(whole, SCHEMA)
    day = 86_400_000_000
    order = PackedOrder(fields(10**12), microseconds=day)
    assert "decimal(38,0)" not in plan_of(bars(df, ["1D"], order_by=order))
    expected = bars(df, ["1D"], order_by=("ts", "trade", "part", "cents", "price"))
    assert collected(bars(df, ["1D"], order_by=order)) == collected(expected)
    hours = PackedOrder(fields(), microseconds=day // 24)
    assert collected(bars(df, ["1D", "4H"], order_by=hours)) == collected(bars(df, ["1D", "4H"], order_by=("ts", "trade", "part", "cents", "price")))


@pytest.mark.parametrize("change, message", [
    ({"trade": 4}, "trade is not within -3 to 3"),
    ({"trade": None}, "trade is not within -3 to 3 in steps of 1/1: null"),
    ({"cents": 0.3}, "cents is not within 0 to 5 in steps of 1/4: 0.3"),
    ({"cents": float("nan")}, "cents is not within"),
])
def test_values_outside_the_declared_range_fail(spark, change, message):
    good = dict(zip(("symbol", "ts", "price", "size", "trade", "part", "cents"), rows(1)[0]))
    df = spark.createDataFrame([tuple((good | change).values())], SCHEMA)
    with pytest.raises(Exception, match=message):
        bars(df, order_by=PackedOrder(fields())).collect()


def test_stamps_off_the_steps_fail(spark):
    df = spark.createDataFrame([r for r in rows(50) if r[1].hour], SCHEMA)
    with pytest.raises(Exception, match="ts is not on a step"):
        bars(df, ["1D"], order_by=PackedOrder(fields(), microseconds=86_400_000_000)).collect()
    with pytest.raises(Exception, match="ts is not on a step of 1000000 microseconds"):
        bars(df, ["1D"], order_by=PackedOrder(fields(), microseconds=1_000_000)).collect()


def test_what_does_not_fit_is_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="38 digits"):
        bars(df, order_by=PackedOrder([OrderField("trade", 0, 10**18), OrderField("part", 0, 10**15)]))
    with pytest.raises(ValueError, match="whole number of steps"):
        bars(df, ["5M"], order_by=PackedOrder([], microseconds=7_000_000))


def test_suppliers_are_aggregated_by_hash(spark):
    plan = plan_of(driver.queries()["supplier_latest_bars"](spark, "/root/testdata/sf0.001"))
    assert "SortAggregate" not in plan and "partial_min_by(price" in plan
