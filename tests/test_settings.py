"""Results must not depend on session settings a user may have."""

from __future__ import annotations

import pytest

from barloom import (
    TIMEFRAMES,
    bars,
    latest_bars,
    read_bars,
    report_from_trades,
    write_bars,
)
from tests.fixtures import TRADE_SCHEMA, collected
from tests.test_bars import brute_force, random_trades
from tests.test_documents import documents, expected_document

SETTINGS = [
    ("spark.sql.adaptive.enabled", "false"),
    ("spark.sql.ansi.enabled", "false"),
    ("spark.sql.shuffle.partitions", "1"),
    ("spark.sql.shuffle.partitions", "200"),
    ("spark.sql.codegen.wholeStage", "false"),
    ("spark.sql.requireAllClusterKeysForDistribution", "true"),
    ("spark.sql.timestampType", "TIMESTAMP_NTZ"),
]


@pytest.mark.parametrize("key, value", SETTINGS)
def test_bars_documents_and_tables(spark, conf, tmp_path, key, value):
    conf(key, value)
    rows = random_trades(17, 900, ["A/B", "C/D", "E/F"], 3)
    trades = spark.createDataFrame(rows, TRADE_SCHEMA)
    built = bars(trades)
    expected = brute_force(rows, TIMEFRAMES)
    assert collected(built) == expected

    report_from_trades(trades, str(tmp_path / "documents"), limit=30)
    written = documents(tmp_path / "documents")
    for symbol, frame in built.toPandas().groupby("symbol"):
        assert written[symbol.replace("/", "")] == expected_document(symbol, frame, 30)

    write_bars(latest_bars(built, 30), str(tmp_path / "table"))
    stored = collected(read_bars(spark, str(tmp_path / "table")))
    kept = latest_bars(built, 30)
    assert stored == collected(kept)
