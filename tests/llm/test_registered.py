"""Every registered corpus query over the smallest given tables, whole, against SQL or a brute-force version of what its contract fixes."""

import hashlib
import os
import re
import zlib

import duckdb
import pytest
import sentencepiece

from skyloom.llm import pieces, queries

from . import test_clusters, test_licenses, test_neardup, test_pii, test_rules, test_substrings, test_whitening

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "benchmark", "conversations", "embeddings")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


@pytest.fixture(scope="module")
def out(spark):
    made = {}

    def rows(name):
        if name not in made:
            made[name] = queries.QUERIES[name](spark, SF).collect()
        return made[name]

    return rows


def crc(i):
    return zlib.crc32(str(i).encode())


def once_each(rows, texts):
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(out, duck, name):
    got = out(name)
    want = duck.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(want.fetchall())


def test_op1_equals_brute_force(out, texts):
    ids = sorted(texts)
    want = [(ids[i], n, ids[c], kept) for i, n, c, kept in test_neardup.brute([texts[i] for i in ids], 2, 80)]
    assert sorted(tuple(r[:4]) for r in out("op1_minhash_near_dedup")) == want


def test_op2_scores_held_out_rows(out, texts, duck):
    got = once_each(out("op2_quality_classifier"), texts)
    for i, r in got.items():
        assert r["held_out"] == (crc(i) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(q, got[i]["predicted"]) for i, q in duck.execute("select doc_id, quality from labels where quality is not null").fetchall() if got[i]["held_out"]]
    assert sum(q == p for q, p in held) >= 0.85 * len(held)


def test_op3_predicts_held_out_rows(out, texts, duck):
    got = once_each(out("op3_language_id"), texts)
    langs = dict(duck.execute("select doc_id, lang from documents").fetchall())
    learned = {langs[i] for i in texts if crc(i) % 5 and langs[i]}
    for i, r in got.items():
        assert r["held_out"] == (crc(i) % 5 == 0) and 0 <= r["score"] <= 1 and r["lang_pred"] in learned | {"und"}
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", texts[i] or ""))
    held = [i for i, r in got.items() if r["held_out"] and langs[i] and r["lang_pred"] != "und"]
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.95 * len(held)


def test_op4_base_equals_brute_force(out, texts):
    for i, r in once_each(out("op4_pii"), texts).items():
        want, line = test_pii.brute(texts[i])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want
        spans = list(filter(None, r["spans"].split(",")))
        assert set(filter(None, line.split(","))) <= set(spans)
        assert r["n_added"] == len(spans) - sum(want[:4]) and r["n_secret"] == sum(s.startswith("secret:") for s in spans)


def test_op5_base_equals_brute_force(out, texts):
    for i, r in once_each(out("op5_license_scan"), texts).items():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == test_licenses.brute(texts[i])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_op6_equals_brute_force(out, texts):
    ids = sorted(texts)
    want = [(ids[k], *rest) for k, *rest in test_substrings.brute([texts[i] for i in ids])]
    assert sorted(tuple(r[:5]) for r in out("op6_suffix_array_dedup")) == want


def test_op6_spans_cut_the_text(out, texts):
    for i, r in once_each(out("op6_suffix_array_dedup"), texts).items():
        spans = [tuple(map(int, s.split(":"))) for s in filter(None, r["spans"].split(","))]
        raw, at, left = (texts[i] or "").encode(), 0, b""
        for a, z in spans:
            left, at = left + raw[at:a], z
        left += raw[at:]
        assert len(spans) == r["n_spans"] and sum(z - a for a, z in spans) == r["n_removed"]
        assert hashlib.sha256(left).hexdigest() == r["kept_sha256"]


def test_op6_passages_equal_brute_force(out, texts):
    got = once_each(out("op6_suffix_array_dedup"), texts)
    ids = sorted(texts)
    for i, want in zip(ids, test_substrings.brute_passages([texts[i] for i in ids]), strict=True):
        assert got[i]["n_passages"] == len(want) and got[i]["passages"] == ",".join(f"{a}:{z}" for a, z in want)


def test_op7_base_equals_brute_force(out, texts):
    for i, r in once_each(out("op7_quality_rules"), texts).items():
        n, *rest = test_rules.brute(texts[i])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 10 or 100 * rest[-1] > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_op8_finds_exact_copies(out, texts, duck):
    plain = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) + " "
    items = {i: plain(t) for i, t in duck.execute("select item_id, text from benchmark").fetchall()}
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in out("op8_decontamination")}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x.strip() and x in plain(t)}
    assert exact and all(found[k] == 1.0 for k in exact)
    assert all(0.5 <= s <= 1 for s in found.values())


def test_op9_has_the_probe_conversation(out):
    probe = next(r for r in out("op9_chat_formatting") if r["conv_id"] == -1)
    text = "<|im_end|><|im_start|>assistant ok"
    turns = "".join(f"{role}\n{text}\n" for role in ("user", "assistant"))
    assert probe["n_turns"] == 2 and probe["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert probe["loss_chars"] == len(text) and probe["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.skipif(not os.path.exists(pieces.MODEL_PATH), reason="no tokenizer files")
def test_op10_equals_the_library(out, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    for i, r in once_each(out("op10_sentencepiece"), texts).items():
        ids = model.encode(texts[i] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_op11_equals_brute_force(out, duck):
    rows = duck.execute("select vec_id, embedding from embeddings").fetchall()
    assert sorted((tuple(r) for r in out("op11_centroid_clustering")), key=str) == test_clusters.brute(rows)


def test_op12_equals_numpy(out, duck):
    test_whitening.check(duck.execute("select vec_id, embedding from embeddings").fetchall(), out("op12_embedding_whitening"))


def test_op13_equals_brute_force(out, texts):
    ids = sorted(texts)
    want = [(ids[i], n, ids[c]) for i, n, c, _ in test_neardup.brute([texts[i] for i in ids], 4, 85)]
    assert sorted(map(tuple, out("op13_ngram_jaccard_join"))) == want
