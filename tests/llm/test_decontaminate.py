from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import decontaminate as dc
from tests.llm.helpers import docs, empty

ITEMS = "item_id long, text string"


def _words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _brute(text, items):
    words, hit, found = _words(text), set(), set()
    for item, wanted in items:
        parts = _words(wanted)
        n = min(10, len(parts))
        windows = {tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)} if parts else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


some_text = st.lists(st.sampled_from(["a", "B", "c!", "é", "İ", " ", "7", "d\n"]), max_size=40).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(some_text, st.lists(some_text, max_size=4))
def test_hits_equal_brute_force(text, wanted):
    items = list(enumerate(wanted))
    rows = [(str(i), w) for i, t in items for w in dc.item_windows(dc.normal_words(t.encode()))]
    words = dc.normal_words(text.encode())
    spans, found = dc.WindowSet.of(rows).find(words)
    hit = sum(e - s for s, e in dc.merged(spans))
    assert (len(words), hit, sorted(found)) == _brute(text, items)


def test_blocks_give_the_same_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one, many = (dc.scan(table, items, size).orderBy("doc_id").collect() for size in (1 << 20, 200_000))
    assert one == many
    assert any(row.spans for row in one)


def test_spans_and_documents_are_removed(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [f"Before, {item.upper()}; after.", "clean text", f"{item} {item}", None, ""]
    items = spark.createDataFrame([(1, item), (2, None), (None, "..."), (1, item)], ITEMS)
    cleaned = [r.text for r in dc.remove_spans(docs(spark, texts), items).orderBy("doc_id").collect()]
    assert cleaned == ["Before, ; after.", "clean text", "", None, ""]
    left = dc.remove_documents(docs(spark, texts), items)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]
    assert left.columns == docs(spark, texts).columns


def test_short_items_nulls_and_empty_tables(spark):
    items = spark.createDataFrame([(None, "alpha"), (5, "beta gamma")], ITEMS)
    found = dc.scan(docs(spark, ["Alpha beta GAMMA", None], [None, 2]), items).collect()
    assert [(r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in found] == [(3, [(0, 3)], ["", "5"]), (0, [], [])]
    assert dc.scan(empty(spark), items).count() == 0
    none = dc.scan(docs(spark, ["alpha"]), spark.createDataFrame([], ITEMS)).collect()
    assert none[0].n_words == 1 and none[0].spans == []
