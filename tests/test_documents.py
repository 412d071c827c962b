from __future__ import annotations

import io
import json
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import (
    TIMEFRAMES,
    bars,
    document_lines,
    latest_bars,
    read_raw_bars,
    report_from_raw,
    report_from_trades,
    write_documents,
)
from barloom.__main__ import main
from barloom.sources.schemas import BAR_FIELDS, BAR_SCHEMA, RAW_BAR_SCHEMA
from tests.fixtures import (
    GOLDEN_DOCUMENT_START,
    TRADE_SCHEMA,
    bar_table,
    golden_trades,
    plan_of,
    stamp,
)
from tests.test_bars import random_trades

LABELS = [frame.label for frame in TIMEFRAMES]
EMPTY_SECTION = "# TIMEFRAME: {}\n" + ",".join(BAR_FIELDS) + "\n\n"


def documents(path) -> dict[str, str]:
    """Document name without its ending to text; exactly one file per symbol."""
    found = {}
    for folder in Path(path).glob("document=*_MTF_OHLCV.csv"):
        (file,) = folder.glob("*.txt")
        name = folder.name.removeprefix("document=").removesuffix("_MTF_OHLCV.csv")
        found[name] = file.read_text("utf-8")
    return found


def expected_document(symbol: str, frame: pd.DataFrame, limit: int, labels=LABELS) -> str:
    """The document of one symbol, section by section through pandas."""
    out = io.StringIO()
    out.write(f"# SYMBOL: {symbol.replace('/', '')}\n# FORMAT: OHLCV\n")
    for label in labels:
        section = frame[frame.timeframe == label].sort_values("timestamp").tail(limit)
        out.write(f"# TIMEFRAME: {label}\n")
        section[list(BAR_FIELDS)].to_csv(out, index=False)
        out.write("\n")
    return out.getvalue()


def parsed(text: str) -> pd.DataFrame:
    """Test-only reader of a document."""
    head, *sections = text.split("# TIMEFRAME: ")
    symbol = head.splitlines()[0].removeprefix("# SYMBOL: ")
    tables = []
    for section in sections:
        label, _, body = section.partition("\n")
        table = pd.read_csv(io.StringIO(body), parse_dates=["timestamp"], comment="#")
        tables.append(table.assign(symbol=symbol, timeframe=label))
    return pd.concat(tables, ignore_index=True)


def test_golden_document(spark, tmp_path):
    report_from_trades(golden_trades(spark), str(tmp_path))
    (text,) = documents(tmp_path).values()
    assert text.startswith(GOLDEN_DOCUMENT_START)
    frame = bars(golden_trades(spark)).toPandas()
    assert text == expected_document("AAA/BBB", frame, 500)


@pytest.mark.parametrize("limit", [20, 500])
def test_many_documents_match_pandas(spark, tmp_path, limit):
    rows = random_trades(21, 4_000, [f"S{i}/T" for i in range(9)], 6)
    rows = [(s, ts, price * 10 ** (i % 9 - 4), size * 1e6) for i, (s, ts, price, size) in enumerate(rows)]
    built = bars(spark.createDataFrame(rows, TRADE_SCHEMA).repartition(8))
    write_documents(built, str(tmp_path), limit=limit)
    written = documents(tmp_path)
    frame = built.toPandas()
    assert len(written) == 9
    for symbol, part in frame.groupby("symbol"):
        text = written[symbol.replace("/", "")]
        expected = expected_document(symbol, part, limit)
        if text != expected:  # the JVM may print a longer text for the same double
            pd.testing.assert_frame_equal(parsed(text), parsed(expected), check_exact=True)


def test_round_trip(spark, tmp_path):
    rows = random_trades(8, 2_000, ["A/B", "C/D"], 4)
    kept = latest_bars(bars(spark.createDataFrame(rows, TRADE_SCHEMA)), 50)
    write_documents(kept, str(tmp_path), limit=50)
    back = pd.concat([parsed(text) for text in documents(tmp_path).values()])
    frame = kept.toPandas()
    frame["symbol"] = frame.symbol.str.replace("/", "")
    keys = ["symbol", "timeframe", "timestamp"]
    frame, back = (df.sort_values(keys).reset_index(drop=True) for df in (frame, back))
    back["timestamp"] = back.timestamp.astype(frame.timestamp.dtype)
    pd.testing.assert_frame_equal(back[frame.columns], frame, check_exact=True)


def test_raw_bars_with_gaps_and_empty_series(spark, tmp_path):
    records = [
        {"symbol": "AAA/BBB", "timeframe": "4H", "ohlcv": [[1704067200000, 1, 2, 1, 2, None]]},
        {"symbol": "AAA/BBB", "timeframe": "5M", "ohlcv": []},
        {"symbol": "CCC/BBB", "timeframe": "1D", "ohlcv": []},
    ]
    (tmp_path / "raw.json").write_text("\n".join(map(json.dumps, records)))
    raw = read_raw_bars(spark, str(tmp_path / "raw.json"))
    report_from_raw(raw, str(tmp_path / "out"), symbols=["AAA/BBB", "CCC/BBB", "EEE/BBB"])
    sections = [EMPTY_SECTION.format(label) for label in LABELS]
    empty = "# FORMAT: OHLCV\n" + "".join(sections)
    filled = sections.copy()
    # One midnight stamp, so the section prints a date; the null volume is empty text.
    filled[1] = sections[1][:-1] + "2024-01-01,1.0,2.0,1.0,2.0,\n\n"
    assert documents(tmp_path / "out") == {
        "AAABBB": "# SYMBOL: AAABBB\n# FORMAT: OHLCV\n" + "".join(filled),
        "CCCBBB": "# SYMBOL: CCCBBB\n" + empty,
        "EEEBBB": "# SYMBOL: EEEBBB\n" + empty,
    }


def test_empty_pull_without_a_symbol_list_keeps_its_document(spark, tmp_path):
    raw = spark.createDataFrame([("X/Y", "1H", [], None)], RAW_BAR_SCHEMA)
    report_from_raw(raw, str(tmp_path), timeframes=["1H"])
    assert documents(tmp_path) == {
        "XY": "# SYMBOL: XY\n# FORMAT: OHLCV\n" + EMPTY_SECTION.format("1H")
    }


def test_missing_cells_and_stamps(spark, tmp_path):
    rows = [
        ("A", "1H", None, 1.0, None, 1.0, 1.0, 1.0),
        ("A", "1H", "2024-01-01 05:00", None, 2.0, float("nan"), 1.0, 1.0),
    ]
    write_documents(bar_table(spark, rows), str(tmp_path), ["1H"])
    body = documents(tmp_path)["A"].splitlines()[4:]
    # A bar without a time sorts first.
    assert body == [",1.0,,1.0,1.0,1.0", "2024-01-01 05:00:00,,2.0,,1.0,1.0", ""]


def test_section_order_is_the_order_asked_for(spark, tmp_path):
    write_documents(bars(golden_trades(spark)), str(tmp_path), ["5M", "1D"])
    (text,) = documents(tmp_path).values()
    labels = [line for line in text.splitlines() if line.startswith("# TIMEFRAME")]
    assert labels == ["# TIMEFRAME: 5M", "# TIMEFRAME: 1D"]


def test_footer(spark, tmp_path):
    footer = ["# END", "# of the document, naïve – ✓"]
    write_documents(bars(golden_trades(spark)), str(tmp_path), ["1D"], footer_lines=footer)
    (text,) = documents(tmp_path).values()
    assert text.endswith("7.0\n\n# END\n# of the document, naïve – ✓\n")


def test_only_written_symbols_are_replaced(spark, tmp_path):
    path = str(tmp_path)
    both = golden_trades(spark).union(golden_trades(spark, "CCC/DDD"))
    report_from_trades(both, path)
    before = documents(path)
    report_from_trades(both, path, symbols=["CCC/DDD"], timeframes=["1D"], limit=1)
    after = documents(path)
    assert after["AAABBB"] == before["AAABBB"]
    assert after["CCCDDD"].count("\n") == 6 and "2024-01-01" not in after["CCCDDD"]


@pytest.mark.parametrize("one, other", [("A/BC", "AB/C"), ("/", None), ("/", "//")])
def test_symbols_that_share_a_document_fail_the_job(spark, tmp_path, one, other):
    frame = golden_trades(spark).withColumn("symbol", F.lit(one).cast("string"))
    both = frame.union(frame.withColumn("symbol", F.lit(other).cast("string")))
    with pytest.raises(Exception) as failed:
        report_from_trades(both, str(tmp_path))
    assert f"share the document {(one or '').replace('/', '')}_MTF_OHLCV.csv" in str(failed.value)
    assert one in str(failed.value) and str(other or "null") in str(failed.value)
    assert documents(tmp_path) == {}


def test_null_symbol_has_a_whole_document(spark, tmp_path):
    trades = golden_trades(spark).withColumn("symbol", F.lit(None).cast("string"))
    report_from_trades(trades, str(tmp_path), timeframes=["1D"])
    assert documents(tmp_path)[""].startswith("# SYMBOL: \n# FORMAT: OHLCV\n# TIMEFRAME: 1D\n")


def test_overlapping_pulls_print_each_bar_once(spark, tmp_path):
    day = 86_400_000
    pulls = [
        ("A/B", "1D", [[float(d * day), 1.0, 1.0, 1.0, 1.0, v] for d in days], at)
        for days, v, at in ((range(0, 5), 3.0, 1), (range(2, 7), 9.0, 2))
    ]
    raw = spark.createDataFrame(pulls, RAW_BAR_SCHEMA)
    report_from_raw(raw, str(tmp_path), timeframes=["1D"], limit=4)
    rows = documents(tmp_path)["AB"].splitlines()[4:8]
    assert rows == [f"1970-01-0{d},1.0,1.0,1.0,1.0,9.0" for d in (4, 5, 6, 7)]


def test_lines_form_the_document(spark):
    lines = document_lines(bars(golden_trades(spark)))
    rows = lines.orderBy("symbol", "section_no", "part", "timestamp").collect()
    text = "".join(row.line + "\n" for row in rows)
    assert text == expected_document("AAA/BBB", bars(golden_trades(spark)).toPandas(), 500)


def test_bars_are_computed_once(spark):
    plan = plan_of(document_lines(bars(golden_trades(spark)), symbols=["AAA/BBB"]))
    assert plan.count("Scan ExistingRDD") == 1
    assert "Join" not in plan and "Cartesian" not in plan


def test_milliseconds_show_in_the_whole_section(spark):
    df = spark.createDataFrame(
        [
            ("A", "1H", stamp("2024-01-01 00:00:00.250"), 1.0, 1.0, 1.0, 1.0, 1.0),
            ("A", "1H", stamp("2024-01-01 01:00:00"), 1.0, 1.0, 1.0, 1.0, 1.0),
        ],
        BAR_SCHEMA,
    )
    lines = [row.line for row in document_lines(df, ["1H"]).where("part = 2").collect()]
    assert sorted(line.split(",")[0] for line in lines) == [
        "2024-01-01 00:00:00.250",
        "2024-01-01 01:00:00.000",
    ]


def test_command_line(spark, tmp_path):
    golden_trades(spark).write.parquet(str(tmp_path / "trades"))
    out = tmp_path / "out"
    main(["--trades", str(tmp_path / "trades"), "--out", str(out), "--timeframes", "1D", "4H"])
    (text,) = documents(out).values()
    assert text == GOLDEN_DOCUMENT_START

    raw = {"symbol": "A/B", "timeframe": "1D", "ohlcv": [[0, 1, 2, 3, 4, 5]]}
    (tmp_path / "raw.json").write_text(json.dumps(raw))
    main(["--raw", str(tmp_path / "raw.json"), "--out", str(out), "--timeframes", "1D", "--footer", "# x"])
    assert documents(out)["AB"].endswith("1970-01-01,1.0,2.0,3.0,4.0,5.0\n\n# x\n")
    assert documents(out)["AAABBB"] == GOLDEN_DOCUMENT_START
