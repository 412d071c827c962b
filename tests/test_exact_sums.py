"""Volumes that do not depend on the order or the partitioning of trades."""

from __future__ import annotations

import math
import random
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from barloom import bars
from barloom.functions.exact_sums import limb_sums, with_total
from tests.fixtures import TRADE_SCHEMA, collected, golden_rows, golden_trades, plan_of, stamp

# On the grid that the limbs keep whole, every total must be the correctly rounded one.
ON_GRID = st.integers(-(1 << 52), 1 << 52).flatmap(
    lambda m: st.integers(-64, 62).map(lambda e: math.ldexp(m, e))
)


def totals(spark, groups, parts=4):
    rows = [(g, v) for g, values in enumerate(groups) for v in values]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, v double").repartition(parts)
    found = with_total(df.groupBy("g").agg(*limb_sums("total", "v")), "total").collect()
    return {r.g: r.total for r in found}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=st.lists(st.lists(ON_GRID, min_size=1, max_size=12), min_size=1, max_size=40), parts=st.integers(1, 9))
def test_totals_are_rounded_once(spark, groups, parts):
    groups = [values + [-v for v in values[: i % 3]] for i, values in enumerate(groups)]
    assert totals(spark, groups, parts) == {g: math.fsum(values) for g, values in enumerate(groups)}


def test_hard_totals(spark):
    groups = [
        [1e16, 1.0, -1e16], [2.0**115, 2.0**-64, -(2.0**115)], [0.1] * 10, [2.0**53, 1.0], [2.0**53, 1.0, 2.0**-60],
        [2.0**53 + 2, 1.0], [2.0**53 + 2, 1.0, -(2.0**-64)], [-(2.0**53), -1.0, -(2.0**-64)], [0.0, -0.0], [-5.0], [2.0**-64],
        [8e34 / 2, 8e34 / 4], [1.0 / 3, 2.0 / 3, -1.0], [None, 2.5],
    ]
    found = totals(spark, [*groups, [None]])
    assert found.pop(len(groups)) is None
    assert found == {g: math.fsum(v for v in values if v is not None) for g, values in enumerate(groups)}


def test_the_same_bits_under_any_partitioning(spark):
    chance = random.Random(3)
    rows = [
        ("A", stamp(f"2024-01-01 {i % 24:02d}:{i % 60:02d}:00"), 1.0 + i % 7, chance.random() * 10 ** chance.randint(-19, 12))
        for i in range(3000)
    ]
    rows = [(s, ts, p, v) for (s, ts, p, v) in rows]
    seen = set()
    for parts in (1, 2, 5, 16):
        chance.shuffle(rows)
        df = spark.createDataFrame(rows, TRADE_SCHEMA).repartition(parts)
        # Open and close depend on ties of ts here, volumes must not.
        found = bars(df, ["1D", "1H"], exact_volume=True).select("timeframe", "timestamp", "volume").collect()
        seen.add(tuple(sorted((r.timeframe, str(r.timestamp), struct.pack(">d", r.volume)) for r in found)))
    assert len(seen) == 1


def test_bars_are_otherwise_the_same(spark):
    assert collected(bars(golden_trades(spark), exact_volume=True)) == collected(bars(golden_trades(spark)))
    (single,) = {r[-1] for r in collected(bars(golden_trades(spark), ["1D"], exact_volume=True)) if r[2].day == 1}
    assert single == 21.0 and golden_rows()[0][-1] == 21.0
    null = spark.createDataFrame([("A", stamp("2024-01-01"), 1.0, None)], TRADE_SCHEMA)
    assert [r.volume for r in bars(null, exact_volume=True).collect()] == [None] * 5
    assert bars(spark.createDataFrame([], TRADE_SCHEMA), exact_volume=True).count() == 0


@pytest.mark.parametrize("size", [float("nan"), float("inf"), 1e35])
def test_what_has_no_exact_sum_fails(spark, size):
    df = spark.createDataFrame([("A", stamp("2024-01-01"), 1.0, size)], TRADE_SCHEMA)
    with pytest.raises(Exception, match="no exact sum of"):
        bars(df, exact_volume=True).collect()


def test_the_aggregate_stays_hash_based_and_combines_early(spark):
    plan = plan_of(bars(spark.createDataFrame([], TRADE_SCHEMA), exact_volume=True))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("partial_sum") >= 6 and "Python" not in plan
    assert plan.count("Exchange") == plan_of(bars(spark.createDataFrame([], TRADE_SCHEMA))).count("Exchange")


def test_long_chains_of_carries(spark):
    values = [math.ldexp(1, 30 * k - 64) - math.ldexp(1, 30 * k - 94) for k in range(2, 6)] * 50
    assert totals(spark, [values, [-v for v in values]]) == {0: math.fsum(values), 1: -math.fsum(values)}
