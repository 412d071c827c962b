"""Read bar tables written by ``barloom.sinks.tables.write_bars``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.sources.schemas import BAR_COLUMNS, BAR_SCHEMA


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a bar table with its schema given.

    Without the schema, a directory that holds only ``timeframe=1D`` would come
    back as the number 1.0.
    """
    reader = spark.read.schema(BAR_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return reader.format(fmt).load(path).select(*BAR_COLUMNS)
