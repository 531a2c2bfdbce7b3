import os

import pytest
import sentencepiece
from pyspark.sql import functions as F

from skyloom.llm import pieces

from .samples import ODD, documents, prose

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL_PATH), reason="no tokenizer files")
TEXTS = [*ODD, "Hello  world", " a", "▁x ▁▁", "漢字\x00", "a\n b", "ﬁ é é", "  ", " " * 40 + "x", "x" + " " * 50, "Становништво је 😀 \t\t tabs", "     5 5  5", "a" * 300, "aaaa bbbb " * 20, "def f(x):\n    return x  # 123456", "=====-----=====", "🏳️‍🌈 é", "the unbelievable " * 30, prose(1, 4000), "don't can't won't I'll", "日本語のテキスト、これはテストです。" * 20]


def test_ids_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    docs = documents(spark, TEXTS).repartition(3)
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == model.encode(t or ""), repr(t)


def test_round_trip(spark):
    out = pieces.round_trip(documents(spark, TEXTS)).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert r["round_trip"] == ("▁" not in (TEXTS[r["doc_id"]] or ""))
    decoded = pieces.decode(pieces.encode(documents(spark, TEXTS))).collect()
    assert {r["doc_id"]: r["text"] for r in decoded} == {i: (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)}


def test_clashing_columns_and_repeats(spark):
    docs = documents(spark, ["hello world", None]).withColumns({c: F.lit("clash") for c in ("ids", "decoded", "n_tokens", "round_trip")})
    out = pieces.round_trip(docs.union(docs)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in out] == [0, 0, 1, 1] and out[0] == out[1] and out[2]["n_tokens"] == 0


def test_empty_and_strange_ids(spark):
    assert pieces.round_trip(documents(spark, [])).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [-5, 10**6]), (3, [3 + 0xE6])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode(ids).collect()} == {1: "", 2: "", 3: "�"}
