"""Counts of keys in a fixed number of cells, over all rows of a table.

A key is 64 well mixed bits, its cell the first ``bits`` of them. Every task counts in an
array of all cells; pieces of these arrays meet by their number and are added up as they
come. So neither memory nor what reaches the driver grows with the input, and what is
shuffled is about a byte and a half for each key at most.
"""

from __future__ import annotations

import mmap
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1 << 16  # cells in one row on their way
ID_BITS = 22

_U64 = np.uint64
_SCHEMA = "piece int, packed binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U64(30)) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U64(27)) * _U64(0x94D049BB133111EB)
    return x ^ x >> _U64(31)


def cells_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> _U64(64 - bits)).astype(np.int64)


def tally(rows: DataFrame, keys: Callable[[pa.RecordBatch], Iterable[np.ndarray]], bits: int) -> DataFrame:
    """How many keys of all ``rows`` fall in each of ``2**bits`` cells, in pieces for ``gathered``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Mapped apart, so that idle workers give it back whole: malloc would keep as much.
        counts = np.frombuffer(mmap.mmap(-1, 4 << bits), np.uint32)
        for batch in batches:
            for found in keys(batch):
                np.add.at(counts, cells_of(found, bits), np.uint32(1))
        yield from _packed(enumerate(counts[i : i + PIECE] for i in range(0, len(counts), PIECE)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in _unpacked(batch):
                sums[piece] = sums[piece] + counts if piece in sums else counts
        yield from _packed(sums.items())

    return rows.mapInArrow(count, _SCHEMA).repartition("piece").mapInArrow(add, _SCHEMA)


def gathered(pieces: DataFrame, bits: int) -> np.ndarray:
    every = np.zeros(1 << bits, np.uint32)
    for batch in pieces.toArrow().to_batches():
        for piece, counts in _unpacked(batch):
            every[piece * PIECE : (piece + 1) * PIECE] = counts
    return every


def _packed(pieces: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pieces with a count, compressed by the places of their bytes: all but the first are mostly zero."""
    for piece, counts in pieces:
        if counts.any():
            planes = counts.view(np.uint8).reshape(-1, 4).T.tobytes()
            packed = pa.compress(planes, codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([packed], pa.binary())], ["piece", "packed"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for piece, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        planes = pa.decompress(packed, decompressed_size=4 * PIECE, codec="zstd", asbytes=True)
        yield piece, np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def only_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose first column, a long, is in the one column of ``ids``, and few others.

    All rows that an exact join may need are kept, and the others need not be shuffled for it.
    """

    def keys(column: pa.Array) -> np.ndarray:
        return mix(column.to_numpy(zero_copy_only=False).view(_U64) + _U64(1))

    counts = gathered(tally(ids, lambda batch: [keys(batch.column(0))], ID_BITS), ID_BITS)
    taken = rows.sparkSession.sparkContext.broadcast(np.packbits(counts > 0))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells_of(keys(batch.column(0)), ID_BITS)
            yield batch.filter(pa.array((taken.value[at >> 3] << (at & 7) & 0x80) > 0))

    return rows.mapInArrow(keep, rows.schema)
