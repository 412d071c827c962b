"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

The nearest vectors are those of the largest inner product. Each vector gets one more
component that makes all norms of its shard equal; the nearest by that distance are then
those of the largest product, and distances obey the triangle inequality that pruning
relies on.

1.  All vectors are dealt evenly over shards of at most ``shard_rows``. In a shard equal
    vectors are one node with all their ids, so thousands of copies cost one node.
2.  A shard's graph starts with random edges. Nodes are inserted in random order, twice:
    a greedy search from the middle node visits nodes that propose edges; going from the
    nearest to the farthest, an edge is kept unless a kept neighbour is nearer to its
    end by the factor ``alpha`` (1 in the first round). Kept edges are offered backwards
    to their ends, whose lists are pruned in the same way once they are full.
3.  Blocks of queries meet every shard's stored graph, and a beam search of width
    ``beam`` finds each query's nearest nodes of that shard.
4.  Scores of what was found are taken anew in double precision on the given vectors, and
    the best ``k`` of all shards are kept, ties to the smaller id.

No step holds more than a shard and a block of queries; all randomness is seeded, so the
same dealing gives the same result. Recall is a matter of ``degree`` and ``beam``: on
independent directions, the hardest case, see the tests.

Nulls and the like: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id. Vectors of different lengths are
never compared. A query never finds a row with its own id. Repeated rows are all found.
An empty table, or no query, gives no rows. Only the named columns are read, so others
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import grid
from barloom.scratch import stored

SHARD_ROWS = 4096
QUERY_ROWS = 2048
DEGREE = 48
BUILD_BEAM = 64
BEAM = 128
ALPHA = 1.05
SEARCHED = 256  # searches that advance together
EXPANDED = 4  # nodes expanded in one step of a search
SHARDS_TOGETHER = 4  # searched by one task, which keeps the best of all


# --- one shard ---------------------------------------------------------------


class Graph:
    """A shard's distinct vectors, its edges (-1 for none) and the node searches start at."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, start: int):
        self.vectors, self.edges, self.start = vectors, edges, start

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes of each query and their squared distances less the query's.

        Both have ``beam`` columns, nearest first; -1 and infinity where fewer were met.
        """
        found = [self._search(queries[i : i + SEARCHED], beam) for i in range(0, len(queries), SEARCHED)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        count = len(queries)
        norms = np.einsum("nd,nd->n", self.vectors, self.vectors)
        rows = np.arange(count)[:, None]
        seen = np.zeros((count, len(self.vectors) + 1), bool)  # the last column stands for -1
        seen[:, [self.start, -1]] = True
        nodes = np.full((count, beam), -1, np.int32)
        away = np.full((count, beam), np.inf, np.float32)
        nodes[:, 0] = self.start
        away[:, 0] = norms[self.start] - 2 * queries @ self.vectors[self.start]
        done = nodes < 0
        while True:
            order = np.argsort(done, axis=1, kind="stable")[:, :EXPANDED]  # nearest not yet expanded
            fresh = ~done[rows, order]
            if not fresh.any():
                return nodes, away
            done[rows, order] = True
            ends = self.edges[np.where(fresh, nodes[rows, order], -1)]
            ends[~fresh] = -1
            ends = np.sort(ends.reshape(count, -1), axis=1)
            new = ~seen[rows, ends]
            new[:, 1:] &= ends[:, 1:] != ends[:, :-1]
            at, column = np.nonzero(new)
            met = ends[at, column]
            seen[at, met] = True
            width = int(new.sum(axis=1).max(initial=0))
            if not width:
                continue
            place = new.cumsum(axis=1)[at, column] - 1
            more = np.full((count, width), -1, np.int32)
            far = np.full((count, width), np.inf, np.float32)
            more[at, place] = met
            far[at, place] = norms[met] - 2 * np.einsum("md,md->m", self.vectors[met], queries[at])
            every, all_away = np.hstack([nodes, more]), np.hstack([away, far])
            all_done = np.hstack([done, more < 0])
            kept = np.argsort(all_away, axis=1, kind="stable")[:, :beam]
            nodes, away, done = every[rows, kept], all_away[rows, kept], all_done[rows, kept]


def _pruned(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """The edges that each of ``points`` keeps of its candidates (-1 for none)."""
    ordered = np.sort(candidates, axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    ordered[ordered == points[:, None]] = -1
    ends = vectors[ordered]
    own = vectors[points]
    between = np.einsum("pd,pcd->pc", own, ends)
    norms = np.einsum("pcd,pcd->pc", ends, ends)
    away = np.maximum(np.einsum("pd,pd->p", own, own)[:, None] + norms - 2 * between, 0)
    away[ordered < 0] = np.inf
    by = np.argsort(away, axis=1, kind="stable")
    rows = np.arange(len(points))[:, None]
    ordered, away, norms, ends = ordered[rows, by], away[rows, by], norms[rows, by], ends[rows, by]
    apart = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * ends @ ends.transpose(0, 2, 1), 0)
    # Squared distances: the factor alpha counts twice.
    covers = alpha * alpha * apart <= away[:, None, :]
    alive = np.isfinite(away)
    kept = np.zeros_like(alive)
    for place in range(ordered.shape[1]):
        taken = alive[:, place] & (kept.sum(axis=1) < degree)
        kept[:, place] = taken
        alive &= ~(covers[:, place] & taken[:, None])
    out = np.full((len(points), degree), -1, np.int32)
    at, column = np.nonzero(kept)
    out[at, kept.cumsum(axis=1)[at, column] - 1] = ordered[at, column]
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> Graph:
    """The graph over the rows of ``vectors``, which must be distinct."""
    count = len(vectors)
    vectors = vectors.astype(np.float32)
    room = 2 * degree  # lists are pruned to ``degree`` when they overflow this
    chance = np.random.default_rng(count)
    edges = np.full((count, room), -1, np.int32)
    if count > 1:
        edges[:, :degree] = chance.integers(0, count, (count, degree))
    middle = vectors.mean(axis=0)
    start = int(np.argmin(np.einsum("nd,nd->n", vectors - middle, vectors - middle)))
    graph = Graph(vectors, edges, start)
    for factor in (1.0, alpha):
        order = chance.permutation(count)
        for first in range(0, count, SEARCHED):
            points = order[first : first + SEARCHED]
            nodes, _ = graph.search(vectors[points], beam)
            chosen = _pruned(vectors, points, np.hstack([nodes, edges[points]]), factor, degree)
            edges[points] = -1
            edges[points, :degree] = chosen
            _offer_back(graph, points, chosen, factor, degree)
    full = np.flatnonzero((edges >= 0).sum(axis=1) > degree)
    for first in range(0, len(full), SEARCHED):
        points = full[first : first + SEARCHED]
        kept = _pruned(vectors, points, edges[points], alpha, degree)
        edges[points] = -1
        edges[points, :degree] = kept
    graph.edges = np.ascontiguousarray(edges[:, :degree])
    return graph


def _offer_back(graph: Graph, points: np.ndarray, chosen: np.ndarray, alpha: float, degree: int) -> None:
    """Adds an edge back from the end of every chosen edge; prunes lists without room."""
    edges = graph.edges
    sources, ends = np.repeat(points, degree), chosen.ravel()
    sources, ends = sources[ends >= 0], ends[ends >= 0]
    there = (edges[ends] == sources[:, None]).any(axis=1)
    sources, ends = sources[~there], ends[~there]
    order = np.argsort(ends, kind="stable")
    sources, ends = sources[order], ends[order]
    while len(ends):
        # The first offers to each end, as many as it has room for; the rest after pruning.
        first = np.r_[True, ends[1:] != ends[:-1]]
        nth = np.arange(len(ends)) - np.flatnonzero(first)[first.cumsum() - 1]
        held = (edges[ends] >= 0).sum(axis=1)
        fits = held + nth < edges.shape[1]
        edges[ends[fits], (held + nth)[fits]] = sources[fits]
        sources, ends = sources[~fits], ends[~fits]
        full = np.unique(ends)
        for at in range(0, len(full), SEARCHED):
            some = full[at : at + SEARCHED]
            kept = _pruned(graph.vectors, some, edges[some], alpha, degree)
            edges[some] = -1
            edges[some, :degree] = kept


def _reached(edges: np.ndarray, start: int) -> np.ndarray:
    met = np.zeros(len(edges) + 1, bool)
    met[-1] = True  # stands for no edge
    front = np.array([start])
    met[start] = True
    while len(front):
        ends = np.unique(edges[front])
        front = ends[~met[ends]]
        met[front] = True
    return met[:-1]


def connect(graph: Graph) -> None:
    """Gives every node that no path leads to an edge from the nearest node that has one."""
    while not (met := _reached(graph.edges, graph.start)).all():
        lost = np.flatnonzero(~met)[:1]
        nodes, _ = graph.search(graph.vectors[lost], BUILD_BEAM)
        nodes = nodes[0][nodes[0] >= 0]
        free = (graph.edges[nodes] < 0).any(axis=1)
        if not free.any():
            graph.edges = np.hstack([graph.edges, np.full((len(graph.edges), 1), -1, np.int32)])
            free[:] = True
        by = nodes[free][0]
        graph.edges[by, np.flatnonzero(graph.edges[by] < 0)[0]] = lost[0]


# --- the index ---------------------------------------------------------------


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part."""
    some = F.exists(vector, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & grid.is_finite(vector) & some).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    )


_SHARD = "part long, i long, width long, id array<long>, ends array<long>, matrix binary, lifted binary, edges binary, degree long, start long"


def index(
    df: DataFrame,
    key: str,
    vector: str,
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    build_beam: int = BUILD_BEAM,
    alpha: float = ALPHA,
) -> DataFrame:
    """The stored graphs of all shards of ``df``, one row each."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, (table, matrix) in enumerate(grid.matrices(batches)):
            ids, nodes = table["id"].to_numpy(), {}
            node = np.array([nodes.setdefault(row.tobytes(), len(nodes)) for row in matrix + 0.0])
            order = np.lexsort((ids, node))
            distinct = matrix[np.unique(node, return_index=True)[1]]
            lifted = _lifted(distinct)
            graph = build(lifted, degree, build_beam, alpha)
            connect(graph)
            yield pa.RecordBatch.from_pylist([{
                "part": TaskContext.get().partitionId(), "i": i, "width": matrix.shape[1],
                "id": ids[order], "ends": np.cumsum(np.bincount(node)), "matrix": distinct.tobytes(),
                "lifted": graph.vectors.tobytes(), "edges": graph.edges.tobytes(),
                "degree": graph.edges.shape[1], "start": graph.start,
            }], pa.schema([
                ("part", pa.int64()), ("i", pa.int64()), ("width", pa.int64()), ("id", pa.list_(pa.int64())),
                ("ends", pa.list_(pa.int64())), ("matrix", pa.binary()), ("lifted", pa.binary()),
                ("edges", pa.binary()), ("degree", pa.int64()), ("start", pa.int64()),
            ]))

    rows = grid.dealt(usable(df, key, vector), shard_rows)
    return grid.numbered(stored(rows.mapInArrow(shards, _SHARD), "shards"))


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors within the unit ball, with a component more that puts them on its surface."""
    scaled = vectors / np.abs(vectors).max()
    squares = np.einsum("nd,nd->n", scaled, scaled)
    most = squares.max()
    rest = np.sqrt(np.maximum(most - squares, 0))
    return (np.hstack([scaled, rest[:, None]]) / np.sqrt(most)).astype(np.float32)


_FOUND = "query long, query_id long, id long, score double"


def search(shards: DataFrame, queries: DataFrame, key: str, vector: str, k: int, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest rows found for each query: ``query_id``, ``rank`` from 1, ``id``, ``score``.

    A repeated query id has its rows once for each of its rows.
    """
    blocks = grid.packed(usable(queries, key, vector), QUERY_ROWS)
    found = grid.on_pairs(blocks, shards, lambda q, s: _nearest(q, s, k, beam), _FOUND, SHARDS_TOGETHER)
    best = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _nearest(blocks: pa.Table | None, shards: pa.Table | None, k: int, beam: int) -> pa.Table:
    """The nearest ``k`` ids in some shards of one block's queries."""
    at, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    number, own, queries = 0, np.zeros(0, np.int64), np.zeros((0, 0))
    if blocks is not None:
        number, own, queries = blocks["number"][0].as_py(), grid.longs_of(blocks, 0, "id"), grid.matrix_of(blocks, 0)
    for s in range(shards.num_rows if shards is not None else 0):
        if shards["width"][s].as_py() != queries.shape[1]:
            continue
        vectors = grid.matrix_of(shards, s)
        lifted = np.frombuffer(shards["lifted"][s].as_py(), np.float32).reshape(len(vectors), -1)
        edges = np.frombuffer(shards["edges"][s].as_py(), np.int32).reshape(len(vectors), -1)
        graph = Graph(lifted, edges, shards["start"][s].as_py())
        ids, ends = grid.longs_of(shards, s, "id"), grid.longs_of(shards, s, "ends")
        scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
        flat = np.hstack([scaled, np.zeros((len(scaled), 1))]).astype(np.float32)
        nodes, _ = graph.search(flat, max(beam, k + 1))
        for first in range(0, len(nodes), SEARCHED):
            met = nodes[first : first + SEARCHED]
            exact = (vectors[met] * queries[first : first + SEARCHED, None, :]).sum(axis=2)
            rows, columns = np.nonzero(met >= 0)
            node, score = met[rows, columns], exact[rows, columns]
            # Of equal vectors the first k + 1 ids are enough, one being perhaps the query's own.
            begin = np.r_[0, ends[:-1]][node]
            many = np.minimum(ends[node] - begin, k + 1)
            nth = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
            at.append(np.repeat(rows + first, many))
            found.append(ids[np.repeat(begin, many) + nth])
            scores.append(np.repeat(score, many))
            at[-1], found[-1], scores[-1] = _first(at[-1], found[-1], scores[-1], own, k)
    at, found, scores = _first(np.concatenate(at), np.concatenate(found), np.concatenate(scores), own, k)
    return pa.table({
        "query": pa.array(number * (1 << 32) + at), "query_id": pa.array(own[at]),
        "id": pa.array(found), "score": pa.array(scores),
    })


def _first(at: np.ndarray, found: np.ndarray, scores: np.ndarray, own: np.ndarray, k: int):
    """For each query the ``k`` best other ids: highest score, then smallest id."""
    other = found != own[at]
    at, found, scores = at[other], found[other], scores[other]
    order = np.lexsort((found, -scores, at))
    at, found, scores = at[order], found[order], scores[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    return at[nth < k], found[nth < k], scores[nth < k]
