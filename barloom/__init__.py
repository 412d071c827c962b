"""Multi-timeframe price bars on Spark."""

from barloom.functions.text import (
    clean_symbol,
    document_name,
    number_text,
    stamp_text,
    with_number_texts,
)
from barloom.functions.order_keys import OrderField, PackedOrder
from barloom.functions.timeframes import TIMEFRAMES, Timeframe, section_no, with_timeframe_info
from barloom.functions.timestamps import epoch_ms_to_timestamp, timestamp_to_epoch_ms
from barloom.operators.bars import bars, partitions_for, roll_up
from barloom.operators.concat import concat_timeframes, order_bars
from barloom.operators.histogram import bar_histogram, newest_bounds, newest_trades
from barloom.operators.latest import DEFAULT_LIMIT, latest_bars
from barloom.operators.naming import name_bars, newest_pulls
from barloom.operators.select import select_symbols, select_timeframes
from barloom.plans.report import (
    latest_from_raw,
    latest_from_trades,
    report_from_raw,
    report_from_trades,
)
from barloom.sinks.documents import document_lines, write_documents
from barloom.sinks.tables import write_bars
from barloom.sinks.versions import drop_versions, read_version, versions, write_version
from barloom.sources.raw_bars import good_raw, raw_rejects, read_raw_bars, read_raw_lines
from barloom.sources.stored_bars import read_bars
from barloom.sources.trades import as_trades

__all__ = [
    "DEFAULT_LIMIT",
    "OrderField",
    "PackedOrder",
    "TIMEFRAMES",
    "Timeframe",
    "as_trades",
    "bar_histogram",
    "bars",
    "clean_symbol",
    "concat_timeframes",
    "document_lines",
    "document_name",
    "drop_versions",
    "epoch_ms_to_timestamp",
    "good_raw",
    "latest_bars",
    "latest_from_raw",
    "latest_from_trades",
    "name_bars",
    "newest_bounds",
    "newest_pulls",
    "newest_trades",
    "number_text",
    "order_bars",
    "partitions_for",
    "raw_rejects",
    "read_bars",
    "read_raw_bars",
    "read_raw_lines",
    "read_version",
    "report_from_raw",
    "report_from_trades",
    "roll_up",
    "section_no",
    "select_symbols",
    "select_timeframes",
    "stamp_text",
    "timestamp_to_epoch_ms",
    "versions",
    "with_number_texts",
    "with_timeframe_info",
    "write_bars",
    "write_documents",
    "write_version",
]
