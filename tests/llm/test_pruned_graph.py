"""Nearest vectors by pruned graphs: recall against all pairs, exact scores, odd tables."""

from __future__ import annotations

import numpy as np
import pytest

from barloom.llm import pruned_graph, queries

ROWS = "vec_id long, embedding array<float>"


def plain(rows, k, is_query=lambda i: i % 20 == 0):
    """Each query's nearest others: id and score, best first."""
    found = {}
    for query, vector in rows:
        if is_query(query):
            q = np.array(vector, np.float32).astype(float)
            scored = sorted((-float((np.array(v, np.float32).astype(float) * q).sum()), i) for i, v in rows if i != query)
            found[query] = [(i, -s) for s, i in scored[:k]]
    return found


def searched(spark, rows, k=20, schema=ROWS, **index):
    df = spark.createDataFrame(rows, schema)
    shards = pruned_graph.index(df, "vec_id", "embedding", **index)
    found = {}
    for r in pruned_graph.search(shards, df.where("vec_id % 20 = 0"), "vec_id", "embedding", k).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def recall(found, expected):
    return np.mean([len({i for i, _ in found[q]} & {i for i, _ in rows}) / len(rows) for q, rows in expected.items()])


def made_rows(seed, count, size, spread=None):
    chance = np.random.default_rng(seed)
    vectors = chance.normal(size=(count, size))
    if spread is not None:  # a few close groups, the other hard case
        vectors = chance.normal(size=(12, size))[chance.integers(0, 12, count)] + spread * vectors
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("spread", [None, 0.05])
@pytest.mark.parametrize("shard_rows", [3000, 700])
def test_recall_against_all_pairs(spark, spread, shard_rows):
    rows = made_rows(1, 3000, 24, spread)
    expected = plain(rows, 20)
    found = searched(spark, rows, shard_rows=shard_rows)
    assert recall(found, expected) >= 0.97
    for query, nearest in found.items():
        assert len(nearest) == 20
        exact = dict(plain([rows[query], *[rows[i] for i, _ in nearest]], 20, lambda i: i == query)[query])
        assert dict(nearest) == exact


def test_query_reaches_its_recall_on_independent_directions(spark):
    table = queries.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    found = {}
    for r in queries.op11_nearest_vectors(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = plain(rows, 20)
    assert set(found) == set(expected) and recall(found, expected) >= 0.97


def test_lengths_of_vectors_count(spark):
    rows = [(i, [x * (1 + i % 7) for x in v]) for i, v in made_rows(2, 1500, 16)]
    assert recall(searched(spark, rows, shard_rows=600), plain(rows, 20)) >= 0.97


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) if i % 3 == 0 else r for i, r in enumerate(made_rows(3, 900, 4))]
    assert recall(searched(spark, rows, shard_rows=300), plain(rows, 20)) >= 0.97
    same = [(i, [0.5, 0.5]) for i in range(100)]
    assert searched(spark, same) == plain(same, 20)


def test_a_few_rows_are_all_found(spark):
    for count in (2, 7, 21, 60):
        rows = made_rows(count, count, 8)
        assert searched(spark, rows) == plain(rows, 20)
    assert searched(spark, made_rows(1, 1, 8)) == {}
    assert searched(spark, []) == {}
    line = [(i, [1.0, float(i)]) for i in range(1, 300)]
    assert recall(searched(spark, line), plain(line, 20)) == 1


def test_nulls_zeros_and_lengths_take_no_part(spark):
    odd = [None, [], [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 1.0, 1.0, 1.0]]
    rows = made_rows(5, 50, 4)
    others = [(100 + i, [1.0, float(i)]) for i in range(30)]
    found = searched(spark, rows + others + [(20 * (10 + i), v) for i, v in enumerate(odd)] + [(None, [1.0] * 4)])
    assert found == plain(rows, 20) | plain(others, 20)


def test_repeated_ids_and_other_columns(spark):
    rows = made_rows(6, 60, 4)
    assert searched(spark, rows + [rows[7]] * 3) == plain(rows + [rows[7]] * 3, 20)
    once = searched(spark, rows, k=5)
    assert once == plain(rows, 5)
    df = spark.createDataFrame(rows + [rows[20]], ROWS)
    repeated = df.where("vec_id = 20")
    twice = pruned_graph.search(pruned_graph.index(df, "vec_id", "embedding"), repeated, "vec_id", "embedding", 5)
    assert sorted((r.rank, r.id, r.score) for r in twice.collect()) == sorted(
        2 * [(i + 1, *pair) for i, pair in enumerate(once[20])]
    )
    named = [(i, v, 1, 2, 3) for i, v in rows]
    assert searched(spark, named, k=5, schema=ROWS + ", id int, vector int, number int") == once


def test_pruning_keeps_diverse_edges():
    # Ends behind a kept neighbour are covered by it, those on other sides are not.
    vectors = np.array([[0, 0], [1, 0], [2, 0], [3, 0], [0, 1.5], [-1, 0]], np.float32)
    candidates = np.array([[1, 2, 3, 4, 5, 0]], np.int32)
    kept = pruned_graph._pruned(vectors, np.array([0]), candidates, 1.0, 4)
    assert sorted(kept[0][kept[0] >= 0].tolist()) == [1, 4, 5]
    relaxed = pruned_graph._pruned(vectors, np.array([0]), candidates, 2.5, 4)
    assert sorted(relaxed[0][relaxed[0] >= 0].tolist()) == [1, 2, 4, 5]


def test_every_node_is_reached():
    vectors = np.repeat(np.eye(3, dtype=np.float32), 40, axis=0) + np.linspace(0, 1e-3, 120, dtype=np.float32)[:, None]
    graph = pruned_graph.build(vectors, degree=4, beam=6)
    graph.edges[90:] = -1
    graph.edges[graph.edges >= 90] = -1
    pruned_graph.connect(graph)
    assert pruned_graph._reached(graph.edges, graph.start).all()
