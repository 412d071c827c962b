from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import quality, queries
from tests.llm.helpers import docs, empty


def _counts(text: str) -> tuple[int, ...]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(covered),
        len(lines),
    )


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é#|\n\t\r \u0085")))
def test_counts(text):
    assert quality.count_text(text.encode()) == _counts(text)


def test_counts_of_all_documents():
    for text in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text:
        assert quality.count_text(text.encode()) == _counts(text)


def test_query_keeps_good_and_rejects_bad(spark):
    found = queries.op3_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    known = found.merge(labels, on="doc_id")
    assert (found.base_failed == ((found.n_words < 50) | (100 * found.n_repeat_words > 50 * found.n_words))).all()
    assert not found.kept[found.base_failed].any()
    passed = known[~known.base_failed]
    assert passed.kept[passed.quality == 1].mean() > 0.99
    assert passed.kept[passed.quality == 0].mean() < 0.05


def test_odd_rows_have_short_paths():
    rng = np.random.default_rng(1)
    usual = rng.uniform(0, 0.1, (2000, 4))
    forest = quality.grow_forest(usual)
    odd = np.array([[1, 0, 0, 0], [0, 1, 1, 0]], float)
    assert forest.score(odd).min() > forest.score(usual).max()


def test_threshold():
    scores, good = np.array([0.3, 0.4, 0.8, 0.9]), np.array([True, True, False, False])
    assert 0.4 < quality.calibrate(scores, good) < 0.8
    assert quality.calibrate(scores, np.array([True] * 4)) == np.inf
    assert quality.calibrate(scores, np.array([False] * 4)) == np.inf
    assert quality.calibrate(np.array([0.5] * 4), good) == np.inf  # ties cannot be told apart


def test_nulls_long_texts_repeats_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    table = docs(spark, [None, "", long, long, "x"], [None, 1, 2, 2, 3]).withColumn("kept", F.lit("mine"))
    judged = quality.judge(table, None).toPandas()
    assert judged.n_words.tolist() == [0, 0, 200_000, 200_000, 1]
    assert judged.kept.tolist() == [False, False, True, True, False]
    assert list(judged.columns).count("kept") == 1


def test_without_labels_the_rules_decide(spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    table = docs(spark, ["some words"])
    assert quality.fit(table, labels) is None
    assert quality.fit(empty(spark), labels) is None
    assert quality.judge(empty(spark), None).count() == 0
