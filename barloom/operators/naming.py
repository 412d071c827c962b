"""Raw positional bars to named, typed bar rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.timestamps import epoch_ms_to_timestamp
from barloom.sources.schemas import BAR_FIELDS, MEASURES


def name_bars(raw: DataFrame, keep_empty: bool = False, keep_pulled: bool = False) -> DataFrame:
    """One named row per raw bar; a narrow step with no shuffle.

    A bar with fewer than six values is filled up with nulls, one with more
    fails the job. With ``keep_empty`` a pull without bars leaves one row whose
    timestamp and measures are all null, so a document can still show the
    series as an empty section. With ``keep_pulled`` the column ``pulled_at``
    stays, null if the raw table has none.
    """
    unnest = F.explode_outer if keep_empty else F.explode
    row = F.col("row")
    too_long = F.raise_error(F.lit(f"a raw bar holds more than {len(BAR_FIELDS)} values"))
    ms = F.when(F.size(row) > len(BAR_FIELDS), too_long.cast("double")).otherwise(F.get(row, 0))
    pulled = F.col("pulled_at") if "pulled_at" in raw.columns else F.lit(None).cast("long")
    kept = [pulled.alias("pulled_at")] if keep_pulled else []
    return raw.select("symbol", "timeframe", *kept, unnest("ohlcv").alias("row")).select(
        "symbol",
        "timeframe",
        epoch_ms_to_timestamp(ms).alias("timestamp"),
        *[F.get(row, i).alias(name) for i, name in enumerate(MEASURES, start=1)],
        *["pulled_at"] * keep_pulled,
    )


_TIES = 1 << 60  # hash values below one step of pull time


def newest_pulls(named: DataFrame) -> DataFrame:
    """One row per symbol, timeframe and timestamp: the bar of the latest pull.

    Pulls that overlap bring the same bar again, the older one perhaps still open.
    ``named`` comes from ``name_bars(keep_pulled=True)``. A bar without a pull time
    is the oldest. Of equal pull times (so of all, where there are none) a hash of
    the values decides: which bar stays has no meaning then, but is the same in
    every run. Rows without a timestamp are not reduced.

    The order is one decimal of 38 digits, which holds any long as pull time (in whatever
    unit) and 60 bits of the hash below it; so the aggregate is hash-based, and each task
    reduces its own rows first.
    """
    pulled = f"cast(coalesce(pulled_at, cast('{-(1 << 63)}' as bigint)) as decimal(20,0))"
    tie = f"cast(pmod(xxhash64({', '.join(MEASURES)}), {_TIES}L) as decimal(19,0))"
    order = f"{pulled} * cast({_TIES}L as decimal(19,0)) + {tie}"
    latest = [F.expr(f"max_by({name}, {order}) as {name}") for name in MEASURES]
    without_time = F.when(F.col("timestamp").isNull(), F.xxhash64(*MEASURES)).alias("odd")
    return named.groupBy("symbol", "timeframe", "timestamp", without_time).agg(*latest).drop("odd")
