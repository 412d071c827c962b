"""Bar tables as partitioned Parquet or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.text import with_number_texts
from barloom.sources.schemas import BAR_COLUMNS, MEASURES


def write_bars(
    bars: DataFrame, path: str, fmt: str = "parquet", replace: str = "table"
) -> None:
    """Write named bars under ``symbol=<symbol>/``.

    The directory holds the symbol as it is (Spark escapes what a path cannot
    hold), so ``read_bars`` gives it back and symbols that clean alike stay apart.

    ``replace="table"`` replaces everything under ``path`` and splits it by
    symbol and timeframe. ``replace="symbols"`` replaces only the symbols being
    written and leaves the others alone; there a directory is a whole symbol,
    because with one directory per timeframe an older section that the new data
    lacks would survive.

    The rebalance step lets adaptive execution cut a hot symbol into several
    files and pack small ones into one task; nothing else limits file counts.
    """
    layouts = {"table": ("symbol", "timeframe"), "symbols": ("symbol",)}
    if replace not in layouts:
        raise ValueError(f"replace must be one of {sorted(layouts)}, not {replace!r}")
    layout = layouts[replace]
    rows = (
        bars.select(*BAR_COLUMNS)
        .hint("rebalance", *layout)
        .sortWithinPartitions("symbol", "timeframe", "timestamp")
    )
    if fmt == "csv":
        rows = rows.withColumn("timestamp", F.col("timestamp").cast("string"))
        rows = with_number_texts(rows, *MEASURES)
    writer = rows.write.mode("overwrite").partitionBy(*layout).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    mode = "static" if replace == "table" else "dynamic"
    writer.option("partitionOverwriteMode", mode).save(path)
