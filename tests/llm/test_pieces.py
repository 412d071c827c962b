from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import pieces
from tests.llm.helpers import docs, empty

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", " a  b ", "\n\n x\n", "▁a ▁▁b▁", "日本 a\t\x00z", "<s> </s> <0x0A>", "é\n é", "x" * 5000, "  \r\n"]


@pytest.fixture(scope="module")
def model():
    return pieces.Encoder(MODEL)


def _same(model, text):
    ids, starts, ends = model.encode(text.encode())
    assert ids.tolist() == model.whole.encode(text, add_eos=True)
    raw = text.encode()
    assert starts[0] == 0 and ends[-1] == len(raw)
    assert (starts[1:] == ends[:-1]).all()
    for i, s, e in zip(ids.tolist(), starts, ends):
        shown = model.whole.id_to_piece(i).replace("▁", " ")
        if not shown.startswith("<0x") and i != model.end_id and "▁" not in text:
            # The mark that every text gets at its start has no source bytes.
            assert raw[s:e].decode() in (shown, shown[1:] if s == 0 else shown)


def test_odd_texts(model):
    for text in ODD:
        _same(model, text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("the on\n ▁é.\t"), st.characters(exclude_categories=["Cs"]))))
def test_ids_equal_the_library(model, text):
    _same(model, text)


def test_all_documents(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for row in pieces.encode(rows, MODEL, decoded=True).select("text", "ids", "decoded").toLocalIterator():
        ids = model.whole.encode(row.text, add_eos=True)
        assert row.ids == ids
        assert row.decoded == model.whole.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
def test_compiled_maps(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = pieces.sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    spec = proto.normalizer_spec
    assert spec.precompiled_charsmap
    spec.add_dummy_prefix = spec.escape_whitespaces = False
    for squeeze in (True, False):
        spec.remove_extra_whitespaces = squeeze
        library = sentencepiece.SentencePieceNormalizer(model_proto=proto.SerializeToString())
        own = pieces.Normaliser(spec)
        for text in ["ﬁne ½ Ａ", "  a  b ", "①　ｶﾞ x", "é ­y\tz", "Ⅷ ß É", "㍿", ""]:
            shown, source = own(text.encode())
            assert shown.decode() == library.normalize(text)
            assert len(source) == len(shown) + 1
            assert (source[1:] >= source[:-1]).all()


def test_alignment_points_at_the_source():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = pieces.sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    shown, source = pieces.Normaliser(proto.normalizer_spec)("ab ﬁ½".encode())
    assert shown.decode() == "▁ab▁fi1⁄2"
    at = {c: int(source[len(shown.decode()[:i].encode())]) for i, c in enumerate(shown.decode())}
    assert (at["a"], at["f"], at["i"], at["1"]) == (0, 3, 3, 6)


def test_nulls_empty_tables_and_clashing_columns(spark):
    table = docs(spark, [None, "", "a b"]).withColumn("ids", F.lit("mine"))
    rows = pieces.encode(table, MODEL).orderBy("doc_id").collect()
    assert [r.ids for r in rows[:2]] == [[2], [2]]
    assert (rows[2].starts[0], rows[2].ends[-1]) == (0, 3)
    assert pieces.encode(empty(spark), MODEL).count() == 0
    again = pieces.decode(pieces.encode(table, MODEL), MODEL).orderBy("doc_id").collect()
    assert [r.decoded for r in again] == ["", "", "a b"]
