from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import langid, queries
from tests.llm.helpers import docs, empty


def _grams(text):
    shown = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    return Counter(shown[i - 1 : i + 2] for i in range(1, len(shown) - 1) if shown[i] != " ")


def _text(code):
    return "".join(chr(code >> s & 0x1FFFFF) for s in (42, 21, 0))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("abÉß ,1𝔸\n"), max_size=30)), max_size=6), st.integers(3, 40))
def test_grams_equal_brute_force(texts, block):
    before, langid.BLOCK_CHARS = langid.BLOCK_CHARS, block
    try:
        found = [Counter() for _ in texts]
        for rows, codes in langid.grams(texts):
            for row, code in zip(rows.tolist(), codes.tolist()):
                found[row][_text(code)] += 1
    finally:
        langid.BLOCK_CHARS = before
    assert found == [_grams(t) for t in texts]


def test_held_out_accuracy(spark):
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    both = rows.merge(truth, on="doc_id")
    assert len(rows) == len(truth)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]).all()
    assert (both.lang == both.lang_pred)[both.held_out].mean() > 0.98
    assert both.score.between(0, 1).all()


def test_filter_names_all_languages_of_a_gram():
    kept = [("de", 1), ("en", 1), ("en", 2)] + [(f"x{i}", 1000 + i) for i in range(9)]
    names = sorted({language for language, _ in kept})
    model = langid.LanguageFilter.build(names, "en", kept)
    masks = model.contained(np.array([1, 2, 1003, 5], np.uint64))
    named = [{names[i] for i in range(len(names)) if m[i // 8] >> i % 8 & 1} for m in masks]
    assert named == [{"de", "en"}, {"en"}, {"x3"}, set()]
    assert (model.false_positives < 1e-9).all()


def test_undetermined_unknown_and_untrained(spark):
    table = docs(spark, ["the cat and the dog", "le chat et le chien", None, "", "12 !?", "жук"], [1, 2, 3, 4, 5, 6])
    labelled = table.where("doc_id <= 2").withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("fr"))
    model = langid.learn(labelled)
    rows = langid.identify(table.withColumn("score", F.lit("mine")), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["en", "fr", "und", "und", "und", model.languages[model.fallback]]
    assert [r.score for r in rows[2:]] == [0.0] * 4
    nothing = langid.learn(empty(spark))
    assert {r.lang_pred for r in langid.identify(table, nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def test_null_ids_are_not_held_out(spark):
    rows = docs(spark, ["a"], [None]).select(langid.held_out().alias("h")).collect()
    assert rows[0].h is False
