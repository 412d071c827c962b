from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import ngram_join as nj
from barloom.llm.batches import batches_of
from barloom.llm.components import components
from tests.llm.helpers import docs, empty


def _set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def _brute(rows, n, percent):
    sets = {i: _set(t, n) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


def _near_copies(seed, groups=4, copies=30, words=60):
    """Groups of texts with a few changed words each, exact copies and texts of one word."""
    rng = random.Random(seed)
    texts = ["", " \n", "one", "ONE", "two words", "Two  words"]
    for g in range(groups):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            text = base.copy()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                text[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(text))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n, percent, bucket, block", [(3, 90, 32, 1000), (5, 80, 4, 7), (2, 50, 1, 5)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent, bucket, block):
    monkeypatch.setattr(nj, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(nj, "BLOCK_ROWS", block)
    rows = _near_copies(n)
    table = docs(spark, [t for _, t in rows]).repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join(table, n, percent).collect()}
    assert found == _brute(rows, n, percent)


@settings(max_examples=200, deadline=None)
@given(
    st.sets(st.integers(0, 60), min_size=1, max_size=40),
    st.sets(st.integers(0, 60), max_size=12),
    st.lists(st.integers(0, 9), min_size=61, max_size=61),
    st.sampled_from([50, 80, 90, 95]),
)
def test_linked_sets_share_enough_of_their_prefixes(one, change, counts, percent):
    two = one ^ change
    if not two or 100 * len(one & two) < percent * len(one | two):
        return
    table = nj.Frequent(np.arange(61, dtype=np.uint64), np.array(counts))
    chosen = []
    for tokens in (np.array(sorted(one), np.uint64), np.array(sorted(two), np.uint64)):
        k, kept = nj.prefix(tokens, table.of(tokens), percent)
        chosen.append((k, set(kept.tolist())))
    assert len(chosen[0][1] & chosen[1][1]) >= min(chosen[0][0], chosen[1][0])


def test_nulls_repeats_and_one_of_each_group(spark):
    text = "a b c d e f g h i j k l"
    table = docs(spark, [text, text.upper(), text, "other words here now", None, text], [7, 7, None, 3, 4, 9])
    rows = nj.join(table, 5, 80).collect()
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in rows if r.doc_id is not None) == [
        (3, 3, 1), (4, 4, 0), (7, 7, 8), (7, 7, 8), (9, 7, 8),
    ]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    kept = nj.deduplicate(table.withColumn("sig", F.lit("mine")), 5, 80)
    assert kept.columns[-1] == "sig"
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == [3, 4, 7, None]


def test_one_id_with_two_texts_keeps_both(spark):
    table = docs(spark, ["a b c d e f", "u v w x y z"], [5, 5])
    assert nj.deduplicate(table, 3, 90).count() == 2


def test_empty_tables(spark):
    assert nj.join(empty(spark), 3, 90).count() == 0
    assert nj.deduplicate(empty(spark), 5, 80).count() == 0
    assert nj.join(docs(spark, [None, ""]), 3, 90).count() == 2


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_texts_meet_their_places_without_a_broadcast(spark):
    table = docs(spark, [f"{'a b c d e f g h i j k l m n o p ' * 2}{i}" for i in range(6)])
    found = nj.classes(table, 3, 80)
    plan = nj.links(table, found, 3, 80)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_components_of_random_edges(spark):
    rng = random.Random(8)
    for nodes, count in [(30, 20), (200, 150), (200, 400), (50, 49)]:
        edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)]
        edges += [(0, i) for i in range(nodes // 2, nodes)] if nodes == 50 else []
        root = {i: i for e in edges for i in e if e[0] != e[1]}
        for a, b in edges:
            if a != b:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
        found = components(spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.root for r in found.collect()} == root
        for i, r in root.items():
            assert r <= i
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**5)}" for _ in range(150_000)]
    other = words[:100] + ["changed"] * 50 + words[150:]
    table = docs(spark, [" ".join(words), " ".join(other), "short text of its own"])
    assert {r.doc_id: r.component_id for r in nj.join(table, 5, 80).collect()} == {0: 0, 1: 0, 2: 2}


def test_texts_go_to_python_in_batches_of_bounded_bytes(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before, stored = spark.conf.get(key, None), nj.stored
    monkeypatch.setattr(nj, "stored", lambda df, name: seen.update({name: spark.conf.get(key, None)}) or stored(df, name))
    table = docs(spark, ["a b c d e f", "A b c d e f", "x y", None])
    nj.join(table, 3, 90).collect()
    assert {seen[name] for name in ("counts", "classes", "links", "sets")} == {str(nj.BATCH_BYTES)}
    assert spark.conf.get(key, None) == before

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    texts = spark.range(0, 1_000, 1, 1).select(F.repeat(F.lit("x"), 2_000).alias("text"))
    with pytest.raises(ZeroDivisionError), batches_of(spark, 100_000):
        assert max(row.n for row in texts.mapInArrow(rows, "n long").collect()) <= 50
        1 / 0
    assert spark.conf.get(key, None) == before
