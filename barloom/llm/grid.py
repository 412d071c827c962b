"""Numbered blocks of rows, and work on all pairs of two sets of blocks.

A stated set of rows (queries, anchors) meets all rows of a table: both are packed into
blocks of bounded size, every block is sent once to each block of the other side, and a
task holds one pair (or one block and a few of the other side). Nothing passes through
the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.scratch import stored

MOST_TASKS = 10_000  # of one pass over all pairs; further pairs share tasks


def is_finite(vector: str) -> Column:
    """Whether an array column is given, not empty and holds finite numbers only."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & sound, F.lit(False))


def matrices(batches: Iterator[pa.RecordBatch], vector: str = "vector") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A task's rows and their vectors as a matrix, one pair for each length of vector."""
    batches = [batch for batch in batches if batch.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    vectors = rows[vector].combine_chunks() if rows[vector].num_chunks != 1 else rows[vector].chunk(0)
    starts = vectors.offsets.to_numpy()
    lengths, values = np.diff(starts), vectors.values.to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield rows.take(pa.array(at)), values[starts[at][:, None] + np.arange(length)]


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt evenly, whatever its keys, over partitions of about ``rows`` rows."""
    return df.repartition(max(1, -(-df.count() // rows)))


def packed(df: DataFrame, rows: int, dtype: str = "float64") -> DataFrame:
    """Stored blocks: ``number``, ``width``, the columns of ``df`` as arrays, the matrix as bytes.

    ``df`` has a column ``vector``; its other columns are long. Vectors of a block have
    one length (``width``). Blocks have about ``rows`` rows.
    """
    names = [c for c in df.columns if c != "vector"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, (table, matrix) in enumerate(matrices(batches)):
            lists = [pa.array([table[name].to_numpy()], pa.list_(pa.int64())) for name in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([i]), pa.array([matrix.shape[1]]), *lists, pa.array([matrix.astype(dtype).tobytes()])],
                ["part", "i", "width", *names, "matrix"],
            )

    lists = "".join(f"{name} array<long>, " for name in names)
    blocks = stored(dealt(df, rows).mapInArrow(pack, f"part long, i long, width long, {lists}matrix binary"), "blocks")
    return numbered(blocks)


def numbered(blocks: DataFrame) -> DataFrame:
    """``part`` and ``i`` of stored blocks as one small number; few numbers stay unused."""
    each = (blocks.agg(F.max("i")).first()[0] or 0) + 1
    return blocks.select((F.col("part") * each + F.col("i")).alias("number"), *[c for c in blocks.columns if c not in ("part", "i")])


def on_pairs(
    left: DataFrame,
    right: DataFrame,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    together: int = 1,
) -> DataFrame:
    """``work`` on each block of ``left`` with each ``together`` blocks of ``right``."""

    def numbers(blocks: DataFrame) -> int:
        most = blocks.agg(F.max("number")).first()[0]
        return 0 if most is None else most + 1

    ones, others = numbers(left), -(-numbers(right) // together)
    tasks = max(1, min(ones * others, MOST_TASKS))

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))

    lefts = left.select("*", F.col("number").alias("one"), copies(others).alias("other"))
    rights = right.select("*", F.floor(F.col("number") / together).alias("other"), copies(ones).alias("one"))

    def both(one: pa.Table, other: pa.Table) -> pa.Table:
        return work(one, other) if one.num_rows and other.num_rows else empty

    empty = work(None, None)
    return (
        lefts.repartition(tasks, "one", "other").groupBy("one", "other")
        .cogroup(rights.repartition(tasks, "one", "other").groupBy("one", "other"))
        .applyInArrow(both, schema)
    )


def matrix_of(blocks: pa.Table, row: int, dtype: str = "float64") -> np.ndarray:
    """The matrix of one packed block."""
    width = blocks["width"][row].as_py()
    return np.frombuffer(blocks["matrix"][row].as_py(), dtype).reshape(-1, width)


def longs_of(blocks: pa.Table, row: int, name: str) -> np.ndarray:
    """One of a packed block's long columns."""
    return blocks[name][row].values.to_numpy()
