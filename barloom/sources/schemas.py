"""Explicit schemas: nothing in this library infers a type from data."""

from __future__ import annotations

# The six positions of a bar, in order.
BAR_FIELDS = ("timestamp", "open", "high", "low", "close", "volume")
MEASURES = BAR_FIELDS[1:]

# ``pulled_at`` (epoch milliseconds) is optional in the data: it is null where it is missing.
RAW_BAR_SCHEMA = "symbol string, timeframe string, ohlcv array<array<double>>, pulled_at long"

BAR_SCHEMA = "symbol string, timeframe string, timestamp timestamp_ntz, " + ", ".join(
    f"{name} double" for name in MEASURES
)
BAR_COLUMNS = ("symbol", "timeframe", *BAR_FIELDS)
