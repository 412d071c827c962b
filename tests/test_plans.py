"""The physical plans are part of the design: check them."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from barloom import (
    Timeframe,
    as_trades,
    bars,
    document_lines,
    latest_bars,
    latest_from_trades,
    name_bars,
    newest_pulls,
    partitions_for,
    read_bars,
    write_bars,
)
from barloom.sources.schemas import RAW_BAR_SCHEMA
from tests.fixtures import TRADE_SCHEMA, plan_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trades(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    return as_trades(events, "event_type", "ts", "value", F.get_json_object("props", "$.k"))


def exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (\w+)\(([^()]*), \d+\)", plan)


def test_trades_are_scanned_once_and_pruned(trades):
    plan = plan_of(latest_from_trades(trades))
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double,props:string>" in plan
    assert "IsNotNull(value)" in plan


def test_aggregates_are_hash_based_with_a_partial_step(trades):
    plan = plan_of(bars(trades))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert "partial_min_by(price" in plan and "partial_sum(size" in plan


def test_roll_up_adds_one_shuffle_of_base_bars(trades):
    assert len(exchanges(plan_of(bars(trades, ["5M"])))) == 1
    assert len(exchanges(plan_of(bars(trades)))) == 2
    # The rolled-up groups are complete where they are: no shuffle after the expansion.
    plan = plan_of(bars(trades))
    assert plan.index("Generate") < plan.index("Exchange")


def test_latest_is_cut_before_its_shuffle(trades):
    plan = plan_of(latest_bars(bars(trades)))
    assert "row_number(), 500, Partial" in plan and len(exchanges(plan)) == 3


def test_symbol_filter_reaches_the_scan(trades):
    assert "EqualTo(event_type,click)" in plan_of(latest_from_trades(trades, ["click"]))
    for limit in (500, 1_500):
        after = latest_from_trades(trades, limit=limit).where("symbol = 'click'")
        assert "EqualTo(event_type,click)" in plan_of(after)


@pytest.mark.parametrize("limit", [500, 1_500])
def test_symbol_filter_prunes_stored_bars(spark, tmp_path, trades, limit):
    write_bars(bars(trades, ["1D"]), str(tmp_path))
    kept = latest_bars(read_bars(spark, str(tmp_path)), limit).where("symbol = 'click'")
    assert "PartitionFilters: [isnotnull(symbol" in plan_of(kept)


def test_overlapping_pulls_are_reduced_by_hash_before_the_shuffle(spark):
    raw = spark.createDataFrame([], RAW_BAR_SCHEMA)
    plan = plan_of(newest_pulls(name_bars(raw, keep_pulled=True)))
    assert "partial_max_by" in plan and "SortAggregate" not in plan and len(exchanges(plan)) == 1


def test_wide_sets_combine_before_the_shuffle(trades):
    frames = [Timeframe("30D", "30d", 2_592_000), Timeframe("1M", "1m", 60)]
    plan = plan_of(bars(trades, frames))
    assert plan.count("partial_min_by") == 2 and "REPARTITION_BY_COL" not in plan


def test_unwanted_timeframes_are_never_formed(trades):
    plan = plan_of(bars(trades, ["1D"]))
    assert "Generate" not in plan and "86400000000" in plan and "300000000" not in plan


def test_documents_add_one_shuffle(trades):
    plan = plan_of(document_lines(bars(trades)))
    assert len(exchanges(plan)) == 4 and plan.count("FileScan") == 1


def test_naming_raw_bars_needs_no_shuffle(spark):
    raw = spark.createDataFrame([], "symbol string, timeframe string, ohlcv array<array<double>>")
    assert exchanges(plan_of(name_bars(raw))) == []


def test_two_order_columns_still_aggregate_before_the_shuffle(spark):
    df = spark.createDataFrame([], TRADE_SCHEMA + ", trade_id long")
    assert "partial_min_by" in plan_of(bars(df, order_by=("ts", "trade_id")))


def test_no_query_runs_python_or_crosses_tables(spark):
    for name, query in driver.bar_queries().items():
        plan = plan_of(query(spark, SF))
        for word in ("Python", "Pandas", "CartesianProduct", "NestedLoopJoin"):
            assert word not in plan, (name, word)


def test_time_filter_on_trades_reaches_the_scan(trades):
    plan = plan_of(latest_from_trades(trades.where("ts >= timestamp_ntz'2024-01-20'")))
    assert "GreaterThanOrEqual(ts,2024-01-20" in plan


def test_larger_limits_keep_the_cut_when_the_threshold_allows(trades, conf):
    assert "Partial" not in plan_of(latest_bars(bars(trades), 2_000))
    conf("spark.sql.optimizer.windowGroupLimitThreshold", "5000")
    assert "row_number(), 2000, Partial" in plan_of(latest_bars(bars(trades), 2_000))


def test_dealt_trades_fold_and_roll_up_where_they_are(trades):
    plan = plan_of(latest_from_trades(trades, partitions=7))
    assert [parts for _, parts in re.findall(r"Exchange (\w+)\([^()]*, (\d+)\)", plan)] == ["7", "7"]
    assert plan.count("partial_min_by") == 2 and plan.count("FileScan") == 1


def test_tasks_of_sparse_trades_do_not_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(partitions_for, "__defaults__", (500,))
    plan = plan_of(driver.queries()["supplier_latest_bars"](spark, SF))
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    found = [int(parts) for parts in re.findall(r"Exchange \w+\([^()]*, (\d+)\)", plan)]
    assert found == [-(-rows // 500)] * 2
