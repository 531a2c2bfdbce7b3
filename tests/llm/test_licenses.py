import re

from pyspark.sql import functions as F

from skyloom.llm import licenses

from .samples import ODD, documents, prose

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"


def brute(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    hits = [(k, i) for k, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for _, i in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for k, _ in hits}))


def test_base_equals_brute_force(spark):
    texts = [*ODD, "Under the MIT\nLicense, under the mit license. " * 3, "under the mit", "CC-BY-NC cc.by.nc Apache License, Version 2.0", prose(1, 2000) + " apache license version 2", "UNDER THE MIT LICENSÉ", "x under the mit license"]
    out = licenses.digest(licenses.scan(documents(spark, texts))).orderBy("doc_id").collect()
    assert [tuple(r[1:6]) for r in out] == [brute(t) for t in texts]
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_templates(spark):
    texts = [MIT, MIT.replace("this software", "these four other nice programs"), MIT.replace("merge, ", ""), MIT.replace("this software", "one two three four five six seven"), "Licensed under the terms of the MIT License", "creative commons attribution noncommercial 4.0 international license"]
    out = licenses.digest(licenses.scan(documents(spark, texts))).orderBy("doc_id").collect()
    assert [r["labels"] for r in out] == ["mit", "mit", "", "", "mit", "cc-by-nc"]
    assert [r["n_base"] for r in out] == [0] * 6
    assert 0.8 < out[0]["score"] < 1


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_whole_licence_with_bullets_names_and_variants(spark):
    third = BSD[BSD.index(" 3. ") : BSD.index("THIS SOFTWARE")]
    texts = {
        "as it stands": (BSD, True),
        "two clauses": (BSD.replace(third, ""), True),
        "letters for bullets": (BSD.replace(" 1. ", " a) ").replace(" 2. ", " b) ").replace(" 3. ", " c) "), True),
        "no bullets": (BSD.replace(" 1. ", " ").replace(" 2. ", " ").replace(" 3. ", " "), True),
        "another holder": (BSD.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "Example Labs of Upper Lane"), True),
        "other bullets": (BSD.replace(" 1. ", " x. "), False),
        "a word less": (BSD.replace("INDIRECT, ", ""), False),
        "a word more": (BSD.replace("LOSS OF USE", "LOSS OF ALL USE"), False),
        "cut short": (BSD[:-40], False),
    }
    whole = [t for t in licenses.WHOLE if t[0] == "bsd"]
    out = licenses.digest(licenses.scan(documents(spark, [t for t, _ in texts.values()]), templates=whole, phrases={})).orderBy("doc_id").collect()
    assert {n: r["labels"] == "bsd" for n, r in zip(texts, out, strict=True)} == {n: want for n, (_, want) in texts.items()}


def test_every_template_accepts_its_plain_wording():
    for label, t in licenses.TEMPLATES:
        plain = re.sub(r"\(\(\s*([^|()]*)\|[^()]*\)\)", r"\1", t)
        plain = re.sub(r"\[\[|\]\]", " ", re.sub(r"\{\{\d+\}\}", "name", plain)).split()
        a = licenses.Automaton(t)
        assert a.match([licenses.fixed_hash(w) for w in plain])[0] == len(plain), (label, t)


def test_automaton_alternatives():
    a = licenses.Automaton("a b ((c d | e | )) x")
    word = {c: licenses.fixed_hash(c) for c in "abcdexy"}
    for text, want in (("abcdx", 5), ("abex", 4), ("abx", 3), ("abcx", 0), ("abdx", 0), ("abcdex", 0)):
        assert a.match([word[c] for c in text])[0] == want, text


def test_automaton_regions():
    a = licenses.Automaton("a b [[c {{2}} d]] e")
    h = [licenses.fixed_hash(x) for x in "abcdexy"]
    word = dict(zip("abcdexy", h, strict=True))
    for text, want in (("abe", 3), ("abcde", 5), ("abcxde", 6), ("abcxyde", 7), ("abcxyxde", 0), ("abc", 0), ("abxe", 0), ("abcddde", 7)):
        assert a.match([word[c] for c in text])[0] == want, text


def test_clashing_columns_and_repeats(spark):
    docs = documents(spark, ["under the mit license", None]).withColumns({c: docs_clash() for c in ("n_words", "matches", "label")})
    out = licenses.scan(docs.union(docs)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_words"], len(r["matches"])) for r in out] == [(0, 4, 2)] * 2 + [(1, 0, 0)] * 2


def docs_clash():
    return F.lit("clash")


def test_empty(spark):
    assert licenses.digest(licenses.scan(documents(spark, []))).count() == 0
