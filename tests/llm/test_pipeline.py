import os

import pytest
import sentencepiece

import corpus_pipeline
from skyloom.llm import pieces

from .samples import documents, prose
from .test_neardup import brute as brute_groups
from .test_pii import brute as brute_pii

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL_PATH), reason="no tokenizer files")


def test_stages_equal_brute_force(spark, tmp_path):
    good = [prose(i, 30 + i % 150) for i in range(600)]
    good[10] = good[11] + " tail"
    good[20] = good[21]
    good[30] = prose(30, 40) + " " + prose(9000, 25)
    good[40] = f"{prose(40, 40)} reach me@mail.example.com now"
    bad = [prose(i, 60).upper().replace(" ", "!! ### ") for i in range(600, 800)]
    docs = documents(spark, good + bad)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 600)) for i in range(800)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(9000, 25))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = corpus_pipeline.good_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids <= set(range(600)) and len(ids) > 585
    kept = docs.filter("doc_id < 600")
    single = corpus_pipeline.near_duplicates(spark, kept, str(tmp_path))
    want = {i for i, _, _, stays in brute_groups(good, 5, 80) if stays}
    assert {r["doc_id"] for r in single.collect()} == want and 21 not in want and 11 not in want
    clean = corpus_pipeline.decontaminated(spark, spark.createDataFrame(single.collect(), docs.schema), str(tmp_path))
    assert {r["doc_id"] for r in clean.collect()} == want - {30}
    masked = corpus_pipeline.without_personal_data(spark, spark.createDataFrame(clean.collect(), docs.schema), str(tmp_path)).collect()
    for r in masked:
        if brute_pii(good[r["doc_id"]])[1]:
            assert r["text"] == good[r["doc_id"]].replace("me@mail.example.com", "<email>") and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == good[r["doc_id"]]

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    texts = {r["doc_id"]: r["text"] for r in masked}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(set(out) ^ set(texts)) < 20
    for i, r in out.items():
        if i not in texts:
            continue
        assert r["ids"] == model.encode(texts[i]) and r["round_trip"] and r["n_tokens"] == len(r["ids"])


def test_empty_tables_null_ids_and_repeats(spark, tmp_path):
    none = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, prose(9000, 25)), (None, None)], "item_id long, text string")
    some = documents(spark, [prose(1, 40), None, "", prose(9000, 25), prose(2, 30) + " me@mail.example.com"])
    lost = spark.createDataFrame([(None, prose(5, 40), None, None, None), (None, None, None, None, None)], none.schema)
    for name, docs, count in (("none", none, 0), ("some", some.union(some).union(lost), 10)):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, at).collect()
        assert len(out) == count and all(r["round_trip"] for r in out)


def test_rows_without_an_id_are_judged_like_others(spark, tmp_path):
    """Copies among themselves and of rows with ids go, as do benchmark passages; one of each group stays, with its null id."""
    spark.createDataFrame([(1, prose(9000, 25))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = documents(spark, [prose(1, 40), prose(2, 40)])
    texts = [prose(1, 40), prose(3, 40), prose(3, 40), prose(9000, 25), prose(4, 40), None]
    lost = spark.createDataFrame([(None, text, None, None, None) for text in texts], some.schema)
    docs = some.union(lost)
    single = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert single.columns == docs.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in single.collect()), key=str)
    assert rows == sorted([(0, prose(1, 40)), (1, prose(2, 40)), (None, prose(3, 40)), (None, prose(9000, 25)), (None, prose(4, 40)), (None, None)], key=str)
    clean = corpus_pipeline.decontaminated(spark, single, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == [x for x in rows if x[1] != prose(9000, 25)]
