from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from barloom import good_raw, latest_from_raw, name_bars, newest_pulls, raw_rejects, read_raw_bars, read_raw_lines
from barloom.sources.schemas import BAR_COLUMNS
from tests.fixtures import collected, plan_of, stamp

RECORDS = [
    {
        "symbol": "AAA/BBB",
        "timeframe": "1D",
        "ohlcv": [[1704067200000, 1, 2, 1, 2, None], [1704153600000, 0.5, 0.6, 0.4, 0.5, 12]],
    },
    {"symbol": "AAA/BBB", "timeframe": "15M", "ohlcv": [[1704153600123, 1, 1, 1, 1, 1]]},
    {"symbol": "CCC/BBB", "timeframe": "1D", "ohlcv": []},
    {"symbol": "DDD/BBB", "timeframe": "5M", "ohlcv": None},
]

NAMED = [
    ("AAA/BBB", "1D", stamp("2024-01-01"), 1.0, 2.0, 1.0, 2.0, None),
    ("AAA/BBB", "1D", stamp("2024-01-02"), 0.5, 0.6, 0.4, 0.5, 12.0),
    ("AAA/BBB", "15M", stamp("2024-01-02 00:00:00.123"), 1.0, 1.0, 1.0, 1.0, 1.0),
]


def land(tmp_path, records) -> str:
    file = tmp_path / "raw.json"
    file.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return str(tmp_path)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_named_and_typed(spark, conf, tmp_path, zone):
    conf("spark.sql.session.timeZone", zone)
    named = name_bars(read_raw_bars(spark, land(tmp_path, RECORDS)))
    assert tuple(named.columns) == BAR_COLUMNS
    assert [kind for _, kind in named.dtypes] == ["string"] * 2 + ["timestamp_ntz"] + ["double"] * 5
    assert collected(named) == sorted(NAMED, key=repr)


def test_empty_pulls_can_be_kept(spark, tmp_path):
    named = name_bars(read_raw_bars(spark, land(tmp_path, RECORDS)), keep_empty=True)
    empty = [(s, t, *[None] * 6) for s, t in (("CCC/BBB", "1D"), ("DDD/BBB", "5M"))]
    assert collected(named) == sorted(NAMED + empty, key=repr)


def test_filters(spark, tmp_path):
    path = land(tmp_path, RECORDS)
    raw = read_raw_bars(spark, path, symbols=["AAA/BBB", "CCC/BBB"], timeframes=["1D"])
    assert {(row.symbol, row.timeframe) for row in raw.collect()} == {
        ("AAA/BBB", "1D"),
        ("CCC/BBB", "1D"),
    }
    plan = plan_of(raw)
    assert "In(symbol, [AAA/BBB,CCC/BBB])" in plan and "EqualTo(timeframe,1D)" in plan


def test_parquet_landing(spark, tmp_path):
    raw = read_raw_bars(spark, land(tmp_path, RECORDS))
    raw.write.parquet(str(tmp_path / "columnar"))
    again = read_raw_bars(spark, str(tmp_path / "columnar"), fmt="parquet")
    assert collected(name_bars(again)) == sorted(NAMED, key=repr)


def test_short_rows_are_filled_and_long_rows_fail(spark, tmp_path):
    row = {"symbol": "A", "timeframe": "1D", "ohlcv": [[0, 1, 2]]}
    named = name_bars(read_raw_bars(spark, land(tmp_path, [row])))
    assert collected(named) == [("A", "1D", stamp("1970-01-01"), 1.0, 2.0, None, None, None)]
    row["ohlcv"] = [[0, 1, 2, 3, 4, 5, 6]]
    named = name_bars(read_raw_bars(spark, land(tmp_path, [row])))
    with pytest.raises(PySparkException, match="more than 6 values"):
        named.collect()


def test_malformed_record_fails(spark, tmp_path):
    path = land(tmp_path, [RECORDS[0], '{"symbol": "A", "ohlcv": [[oops'])
    with pytest.raises(Exception, match="Malformed records"):
        read_raw_bars(spark, path).collect()


def test_latest_from_raw(spark, tmp_path):
    raw = read_raw_bars(spark, land(tmp_path, RECORDS))
    kept = latest_from_raw(raw, symbols=["AAA/BBB"], limit=1)
    assert collected(kept) == sorted(NAMED[1:], key=repr)


LINES = [
    '{"symbol": "A", "timeframe": "1D", "ohlcv": [[0, 1, 2, 0.5, 1.5, 9], [86400000, 1, 2, 0.5, 1.5, 9, 7]], "pulled_at": 5}',
    '{"symbol": "A", "timeframe": "1H", "ohlcv": [[0, 1, 2], null, []]}',
    '{"symbol": "B", "timeframe": "1D", "ohlcv": null, "more": {"x": 1}}',
    '{"symbol": "B", "timeframe": "1D", "ohlcv": [[0, 1, 2, 3, 4, "x"]]}',
    '{"symbol": "B", "timeframe": "1D", "ohlcv": [[0, 1',
    "not json at all",
    '["an", "array"]',
    '{"timeframe": "1D", "ohlcv": []}',
    '{"symbol": "C", "ohlcv": []}',
    "   ",
    "",
]


def landed(spark, tmp_path, lines=LINES, **more):
    (tmp_path / "raw.json").write_text("\n".join(lines) + "\n")
    return read_raw_lines(spark, str(tmp_path / "raw.json"), **more)


def test_lines_that_cannot_be_read_are_given_out_with_a_reason(spark, tmp_path):
    lines = landed(spark, tmp_path)
    rejected = Counter((r.reason, r.record) for r in raw_rejects(lines).collect())
    broken = "not a raw bar record"
    assert rejected == Counter([
        *[(broken, LINES[i]) for i in (3, 4, 5, 6)], ("no symbol", LINES[7]), ("no timeframe", LINES[8]),
        ("a bar of 7 values", '{"symbol":"A","timeframe":"1D","ohlcv":[8.64E7,1.0,2.0,0.5,1.5,9.0,7.0]}'),
    ])
    good = {(r.symbol, r.timeframe): (r.ohlcv, r.pulled_at) for r in good_raw(lines).collect()}
    assert good == {
        ("A", "1D"): ([[0, 1, 2, 0.5, 1.5, 9]], 5), ("A", "1H"): ([[0, 1, 2], None, []], None), ("B", "1D"): (None, None),
    }
    assert name_bars(good_raw(lines)).count() == 4


def test_good_lines_read_as_before(spark, tmp_path):
    lines = landed(spark, tmp_path, LINES[1:3])
    assert good_raw(lines).collect() == read_raw_bars(spark, str(tmp_path / "raw.json")).collect()
    assert raw_rejects(lines).count() == 0
    assert good_raw(lines).schema == read_raw_bars(spark, str(tmp_path / "raw.json")).schema


def test_filters_keep_every_rejected_line(spark, tmp_path):
    lines = landed(spark, tmp_path, symbols=["A"], timeframes=["1H"])
    assert [(r.symbol, r.timeframe) for r in good_raw(lines).collect()] == [("A", "1H")]
    assert raw_rejects(lines).count() == 6
    plan = plan_of(good_raw(lines))
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_no_lines(spark, tmp_path):
    lines = landed(spark, tmp_path, [""])
    assert good_raw(lines).count() == raw_rejects(lines).count() == 0


def test_pull_times_in_any_unit_and_equal_ones(spark, tmp_path):
    def pulls(rows):
        schema = "symbol string, timeframe string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, pulled_at long"
        return spark.createDataFrame([("A", "1D", stamp("2024-01-01"), o, 1.0, 1.0, 1.0, 1.0, at) for o, at in rows], schema)

    micros, top = 1_704_067_200_000_000, (1 << 63) - 1
    rows = [(1.0, micros), (2.0, micros + 1), (3.0, micros - 1), (9.0, None), (8.0, -5)]
    for chosen, more in ((2.0, []), (4.0, [(4.0, top)]), (5.0, [(5.0, top), (4.0, top - 1)])):
        assert [r.open for r in newest_pulls(pulls(rows + more)).collect()] == [chosen]
    assert [r.open for r in newest_pulls(pulls([(9.0, None), (8.0, -(1 << 62))])).collect()] == [8.0]
    equal = pulls([(float(i), micros) for i in range(300)])
    assert len({newest_pulls(equal.repartition(n)).first().open for n in (1, 3, 7)}) == 1
