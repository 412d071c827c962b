"""Symbols named by a table: the rows of a list, and filters that reach the scan at run time."""

from __future__ import annotations

import pytest

from barloom import bars, latest_from_trades, read_bars, select_symbols, write_bars
from tests.fixtures import TRADE_SCHEMA, bar_table, collected, plan_of, stamp


def trades(spark, names):
    rows = [(n, stamp(f"2024-01-0{1 + i % 5}"), 1.0 + i, 1.0) for i, n in enumerate(names * 3)]
    return spark.createDataFrame(rows, TRADE_SCHEMA)


def names_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def test_rows_are_those_of_a_list(spark):
    df = trades(spark, ["A", "B", "C/D", "", None])
    for names in (["A", "C/D"], ["", "none"], [], ["B"] * 9):
        table = names_of(spark, [*names, None])
        assert collected(select_symbols(df, table)) == collected(select_symbols(df, names))
        assert collected(latest_from_trades(df, table)) == collected(latest_from_trades(df, names))
    assert select_symbols(df, names_of(spark, ["A"])).columns == df.columns


def test_other_columns_of_the_table_do_not_matter(spark):
    df = trades(spark, ["A", "B"]).selectExpr("*", "1 as `a.b`")
    table = names_of(spark, ["A"]).selectExpr("*", "7 as price", "8 as `a.b`")
    assert select_symbols(df, table).columns == df.columns and select_symbols(df, table).count() == 3


def test_a_hundred_thousand_symbols_are_no_large_expression(spark):
    df = trades(spark, ["17", "x"])
    many = spark.range(100_000).selectExpr("cast(id as string) as symbol")
    selected = select_symbols(df, many)
    assert len(plan_of(selected)) < 20_000 and selected.count() == 3


def test_stored_bars_are_pruned_by_partition_at_run_time(spark, tmp_path):
    write_bars(bar_table(spark, [(f"S{i}", "1D", "2024-01-01", 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(12)]), str(tmp_path / "bars"))
    names_of(spark, ["S3", "S5"]).write.parquet(str(tmp_path / "names"))
    table = spark.read.parquet(str(tmp_path / "names"))
    found = select_symbols(read_bars(spark, str(tmp_path / "bars")), table)
    assert "dynamicpruning" in plan_of(found)
    assert {r.symbol for r in found.collect()} == {"S3", "S5"}


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_large_tables_meet_by_shuffle_or_broadcast_with_a_bloom_filter(spark, tmp_path, conf, broadcast):
    conf("spark.sql.autoBroadcastJoinThreshold", broadcast)
    conf("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.range(20_000).selectExpr(
        "cast(id % 5000 as string) as symbol", "timestamp_ntz'2024-01-01' as ts", "1.0D as price", "1.0D as size"
    ).write.parquet(str(tmp_path / "trades"))
    names_of(spark, ["7", "8"]).write.parquet(str(tmp_path / "names"))
    df, table = spark.read.parquet(str(tmp_path / "trades")), spark.read.parquet(str(tmp_path / "names"))
    built = bars(select_symbols(df, table), ["1D"])
    plan = plan_of(built)
    assert "might_contain" in plan or broadcast != "-1"
    assert ("BroadcastHashJoin" in plan) == (broadcast != "-1")
    assert "CartesianProduct" not in plan and built.count() == 2
