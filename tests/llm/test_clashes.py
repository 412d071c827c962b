"""Columns of any name, those used inside included, come back from operators and stages as they went in."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import decontaminate, langid, ngram_join, periodic, quality
from tests.llm.helpers import docs

NAMES = (
    "row", "found", "judged", "guess", "id", "sig", "n_shingles", "component_id", "first", "count", "_id", "_set", "_found", "_guess",
    "_judged", "findings", "_leaks", "has_secret", "n_words", "score", "kept", "items", "spans", "runs", "collapsed", "lang_pred",
    "base_failed", "is_secret", "value", "before", "after", "words", "a.b",
)
TEXT = " ".join(f"{w} {i} {w}ly goes{i} on" for i, w in enumerate("plain other third fourth fifth sixth seventh eighth ninth tenth lower upper inner outer".split()))
OPERATORS = {
    "ngram_join.deduplicate": (lambda spark, d: ngram_join.deduplicate(d, 3, 90), ()),
    "decontaminate.scan": (lambda spark, d: decontaminate.scan(d, _items(spark)), decontaminate.ADDED),
    "decontaminate.remove_documents": (lambda spark, d: decontaminate.remove_documents(d, _items(spark)), ()),
    "decontaminate.remove_spans": (lambda spark, d: decontaminate.remove_spans(d, _items(spark)), ()),
    "langid.identify": (lambda spark, d: langid.identify(d, langid.learn(d)), ("lang_pred", "score")),
    "quality.judge": (lambda spark, d: quality.judge(d, None), (*quality.COUNTS, "base_failed", "score", "kept")),
    "periodic.with_runs": (lambda spark, d: periodic.with_runs(d), ("n_words", "runs", "collapsed")),
    "periodic.collapse": (lambda spark, d: periodic.collapse(d), ()),
}


def _items(spark):
    return spark.createDataFrame([("x", "one two three")], "item_id string, text string")


def _table(spark):
    texts = [TEXT, f"{TEXT} token = \"a1b2c3d4e5f60718\" end", None, "", TEXT.upper() + " x"]
    return docs(spark, texts, [1, 2, 3, 4, 4]).select("*", *[F.lit(i).alias(name) for i, name in enumerate(NAMES)])


def _unchanged(out, added=()):
    rows = out.collect()
    for i, name in enumerate(NAMES):
        if name not in added:
            assert out.columns.count(name) == 1 and {row[name] for row in rows} <= {i}, name
    return rows


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_leave_other_columns_alone(spark, name):
    operator, added = OPERATORS[name]
    assert _unchanged(operator(spark, _table(spark)), added)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_give_back_the_columns_of_documents(spark, name, stage):
    table = _table(spark)
    out = stage(spark, table, "/root/testdata/sf0.001")
    assert out.columns == table.columns and _unchanged(out)


def test_the_last_stage_takes_any_columns(spark):
    out = corpus_pipeline.STAGES[-1][1](spark, _table(spark), "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == 5
