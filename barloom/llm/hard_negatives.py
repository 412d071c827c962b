"""Hard negatives: rows of another label that score close below an anchor's positives.

Scores are inner products of integer vectors, so they are exact. For each anchor, rows
stand in the order of falling score, ties by rising id. Its positives are the first rows
of its own label; each opens a window of scores between two percentages of its own, and
the first rows of another label in that window are its negatives.

1.  Rows and anchors are packed into blocks, and every block of anchors meets every block
    of rows (matrix products). A pair of blocks hands on only the best ``positives`` rows
    of an anchor's label, which the best of all blocks are among.
2.  Once an anchor's positives are known, the pairs of blocks are visited again and hand
    on the first ``negatives`` rows of each of its windows. Rows that cannot be in the
    result are thus left out before any shuffle, without a cap: what an anchor receives
    are ``positives * negatives`` rows from each block at most.
3.  Each score goes with its anchor and id into one binary key whose byte order is
    (anchor, falling score, rising id). Rows are dealt by anchor and sorted by key within
    their partition (the DataFrame form of a repartition with a sort within partitions).
4.  A streaming iterator reads the sorted rows. A positive opens its window; a negative
    goes to every open window it lies in that is not yet full. Only the open windows of
    one anchor are held, never an anchor's rows. A window may hold its positive's own
    score (at score 0, or up to 100 %), so the first negatives of the current score are
    remembered for positives that follow.

Nulls and the like: rows with a null id or label, a null or empty vector or a null
component take no part. Vectors of different lengths never meet. A row is known by its
id: no row with the anchor's id is its positive; of a repeated anchor id every row is an
anchor, and repeated rows count each. A positive of negative score has no window, as the
bounds then exclude each other (or allow its own score alone, if both are 100 %). An inner product beyond 64 bits fails the job. Empty
tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import grid
from barloom.scratch import stored

BLOCK_ROWS = 4096
ANCHOR_ROWS = 2048
SCORED = 256  # anchors scored at once

_U64 = np.uint64
_SIGN = _U64(1 << 63)
_SCORED = "anchor long, anchor_id long, id long, score long"
_NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    rows: DataFrame,
    key: str,
    label: str,
    vector: str,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
) -> DataFrame:
    """The negatives of every anchor and positive, with ``rank`` from 1 and both scores.

    ``vector`` is an array of integers; a negative has at least ``low_percent`` and at
    most ``high_percent`` of its positive's score.
    """
    if high_percent > 100:
        raise ValueError("negatives score at most as high as their positive")
    sound = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda x: x.isNotNull())
    kept = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & sound)

    def taken(some: DataFrame) -> DataFrame:
        return some.select(
            F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
            F.col(vector).cast("array<long>").alias("vector"),
        )

    blocks = grid.packed(taken(kept), BLOCK_ROWS, "int64")
    anchors = grid.packed(taken(kept.where(is_anchor)), ANCHOR_ROWS, "int64")
    near = grid.on_pairs(anchors, blocks, lambda a, b: _best_of_label(a, b, positives), _SCORED)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = stored(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).drop("rank"), "positives")
    windows = best.groupBy(F.shiftright("anchor", 32).alias("number")).agg(
        F.collect_list(F.struct(F.col("anchor").bitwiseAND(0xFFFFFFFF).alias("at"), "score")).alias("windows")
    )  # at most a block's anchors, each with its positives
    below = grid.on_pairs(
        stored(anchors.join(windows, "number"), "anchors"), blocks,
        lambda a, b: _first_in_windows(a, b, negatives, low_percent, high_percent), _SCORED,
    )
    keyed = best.mapInArrow(lambda batches: (_keyed(batch, True) for batch in batches), _KEYED).union(
        below.mapInArrow(lambda batches: (_keyed(batch, False) for batch in batches), _KEYED)
    )
    dealt = keyed.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key", "is_positive")
    return dealt.mapInArrow(lambda batches: _stream(batches, negatives, low_percent, high_percent), _NEGATIVES)


# --- scores of a pair of blocks ----------------------------------------------


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = left.shape[1] * _most(left) * _most(right)
    if most < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return left @ right.T
    raise OverflowError("an inner product does not fit in 64 bits")


def _most(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.max())), abs(int(matrix.min())))


def _ranks(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its columns by falling score, equal ones by rising column; and those scores.

    Score and column go into one number where it has room, which sorts faster.
    """
    bits = max(1, scores.shape[1] - 1).bit_length()
    if max(abs(int(scores.max())), abs(int(scores.min()))) < 1 << (62 - bits):
        last = (1 << bits) - 1
        both = np.sort((-scores << bits) | np.arange(scores.shape[1]), axis=1)
        return both & last, -(both >> bits)
    order = np.argsort(-scores, axis=1, kind="stable")
    return order, np.take_along_axis(scores, order, axis=1)


def _sides(anchors: pa.Table | None, blocks: pa.Table | None) -> Iterator[tuple]:
    """Number, ids, labels and matrix of a block of anchors; ids, labels and matrix of rows by id."""
    if anchors is None or blocks is None or anchors["width"][0] != blocks["width"][0]:
        return
    ids = grid.longs_of(blocks, 0, "id")
    by_id = np.argsort(ids, kind="stable")
    yield (
        anchors["number"][0].as_py(), grid.longs_of(anchors, 0, "id"), grid.longs_of(anchors, 0, "label"),
        grid.matrix_of(anchors, 0, "int64"), ids[by_id], grid.longs_of(blocks, 0, "label")[by_id],
        grid.matrix_of(blocks, 0, "int64")[by_id],
    )


def _scored(number: int, own: np.ndarray, at: list, ids: list, scores: list) -> pa.Table:
    at, ids, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, ids, scores))
    return pa.table({
        "anchor": pa.array((number << 32) + at), "anchor_id": pa.array(own[at]),
        "id": pa.array(ids), "score": pa.array(scores),
    })


def _best_of_label(anchors: pa.Table | None, blocks: pa.Table | None, positives: int) -> pa.Table:
    number, own, at, ids, scores = 0, np.zeros(0, np.int64), [], [], []
    for number, own, labels, matrix, others, other_labels, other in _sides(anchors, blocks):
        for label in np.intersect1d(labels, other_labels):
            mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(other_labels == label)
            for first in range(0, len(mine), SCORED):
                some = mine[first : first + SCORED]
                column, score = _ranks(_products(matrix[some], other[theirs]))
                found = others[theirs][column]
                not_own = found != own[some][:, None]
                best = not_own & (not_own.cumsum(axis=1) <= positives)
                at.append(some[np.nonzero(best)[0]])
                ids.append(found[best])
                scores.append(score[best])
    return _scored(number, own, at, ids, scores)


def _first_in_windows(
    anchors: pa.Table | None, blocks: pa.Table | None, negatives: int, low: int, high: int
) -> pa.Table:
    number, own, at, ids, scores = 0, np.zeros(0, np.int64), [], [], []
    for number, own, labels, matrix, others, other_labels, other in _sides(anchors, blocks):
        windows = anchors["windows"].combine_chunks().values if anchors["windows"].num_chunks else None
        place, best = windows.field("at").to_numpy(), windows.field("score").to_numpy()
        with_window = np.unique(place)
        by_place = np.argsort(place, kind="stable")
        tops = np.split(best[by_place], np.searchsorted(place[by_place], with_window)[1:])
        for first in range(0, len(with_window), SCORED):
            some = with_window[first : first + SCORED]
            column, score = _ranks(_products(matrix[some], other))
            differs = other_labels[column] != labels[some][:, None]
            for i, anchor in enumerate(some):
                left, falling = column[i][differs[i]], -score[i][differs[i]]
                wanted = np.zeros(len(left), bool)
                for top in set(tops[first + i].tolist()):
                    begin = np.searchsorted(falling, -(high * top // 100), "left")
                    end = np.searchsorted(falling, low * top // -100, "right")  # -ceil(low * top / 100)
                    wanted[begin : min(end, begin + negatives)] = True
                ids.append(others[left[wanted]])
                scores.append(-falling[wanted])
                at.append(np.full(wanted.sum(), anchor))
    return _scored(number, own, at, ids, scores)


# --- keys and the stream -----------------------------------------------------

_KEYED = "key binary, anchor_id long, is_positive boolean"


def _keyed(batch: pa.RecordBatch, is_positive: bool) -> pa.RecordBatch:
    """Anchor, falling score and rising id as 24 bytes whose order is theirs."""
    anchor, ids, score = (batch.column(name).to_numpy().view(_U64) for name in ("anchor", "id", "score"))
    parts = np.stack([anchor ^ _SIGN, ~(score ^ _SIGN), ids ^ _SIGN], axis=1).astype(">u8")
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(24), len(parts), [None, pa.py_buffer(parts.tobytes())])
    flags = pa.array(np.full(len(parts), is_positive))
    return pa.RecordBatch.from_arrays([keys.cast(pa.binary()), batch.column("anchor_id"), flags], ["key", "anchor_id", "is_positive"])


def _unkeyed(keys: pa.Array) -> np.ndarray:
    """Anchor, score and id of each key, as rows of longs."""
    parts = np.frombuffer(b"".join(keys.to_pylist()), ">u8").astype(_U64).reshape(-1, 3)
    parts = parts ^ _SIGN
    parts[:, 1] = ~parts[:, 1]
    return parts.view(np.int64)


def _stream(batches: Iterator[pa.RecordBatch], negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    anchor, last, windows, tied = None, None, [], []
    for batch in batches:
        out: list[tuple] = []

        def give(window: list, ident: int, score: int, anchor_id: int) -> None:
            """A negative for a window: its positive's id and score, and how many it has."""
            window[2] += 1
            out.append((anchor_id, window[0], window[2], ident, window[1], score))

        rows = zip(_unkeyed(batch.column(0)).tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        for (number, score, ident), anchor_id, is_positive in rows:
            if number != anchor:
                anchor, last, windows = number, None, []
            if score != last:
                last, tied = score, []
            if is_positive:
                windows.append([ident, score, 0])
                for held in tied if low * score <= 100 * score <= high * score else []:
                    give(windows[-1], held, score, anchor_id)
                continue
            for window in windows:
                if window[2] < negatives and low * window[1] <= 100 * score <= high * window[1]:
                    give(window, ident, score, anchor_id)
            if len(tied) < negatives:
                tied.append(ident)
        columns = list(zip(*out)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)],
            ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
        )
