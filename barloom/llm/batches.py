"""Arrow batches of bounded bytes, and stretches of them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """What runs inside sends rows to Python in batches of about ``most_bytes``, or of one larger row.

    Spark holds each batch several times outside its heap: as vectors, as the stream to
    Python and as the one that comes back. Batches cut by rows alone take 10,000 texts.
    """
    before = spark.conf.get(_BYTES, None)
    spark.conf.set(_BYTES, str(most_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BYTES)
        else:
            spark.conf.set(_BYTES, before)


def bound_batches(spark: SparkSession, most_bytes: int) -> None:
    """From now on the session sends rows to Python in batches of about ``most_bytes``, or of one larger row.

    For frames that are returned before they run: Spark reads the setting only when they do.
    """
    spark.conf.set(_BYTES, str(most_bytes))


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Starts and lengths of stretches of rows, each ended once it has ``most_bytes`` of text."""
    start = size = 0
    for i, length in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        size += length
        if size >= most_bytes:
            yield start, i + 1 - start
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts) - start
