"""Licence texts found by templates with optional and replaceable regions.

A template is wording with markup: ``[[ ... ]]`` is optional, ``((a | b))`` one
of several wordings, ``{{n}}`` stands for up to n words of any kind; regions may
be nested. There are templates of whole licences and notices, with their
bullets, names and variants, and of clauses that name a licence. Each is compiled into an automaton over words,
which accepts a passage only if all mandatory words are there, in order, with
nothing between them but what the markup allows. Passages are tried where a
template's opening words stand. Case, punctuation and line breaks don't count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.textops import ALNUM_WORD, U, eights, fixed_hash, slices, spans_hash, words

#: Phrases that the base rule looks for, word by word.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Wording of whole licences and notices.
WHOLE = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of {{6}} [[and associated documentation files]] [[the {{3}}]] to deal in
        {{4}} without restriction including without limitation [[on]] the rights to use copy modify merge publish distribute sublicense and or sell copies of {{4}}
        and to permit persons to whom {{4}} is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        [[including the next paragraph]] shall be included in all copies or substantial portions of {{4}} {{4}} is provided as is without warranty of any kind
        express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and ((noninfringement | non infringement))
        in no event shall {{20}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
        connection with {{4}} or the use or other dealings in {{4}}"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        [[((1 | a))]] ((redistributions | redistribution)) of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [[((2 | b))]] ((redistributions | redistribution)) in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
        in the documentation and or other materials provided with the distribution
        [[ [[((3 | c))]] neither the name of {{12}} [[nor the names of its contributors]] may be used to endorse or promote products derived from this software
        without specific prior written permission ]]
        this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability
        and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential
        damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on
        any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software
        even if advised of the possibility of such damage"""),
    ("isc", """permission to use copy modify and ((or distribute | distribute)) this software for any purpose with or without fee is hereby granted provided that the
        above copyright notice and this permission notice appear in all copies the software is provided as is and {{4}} disclaims all warranties with regard to this
        software including all implied warranties of merchantability and fitness in no event shall {{4}} be liable for any special direct indirect or consequential
        damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out
        of or in connection with the use or performance of this software"""),
    ("apache-2", """licensed under the apache license version 2 [[0]] the license you may not use {{4}} except in compliance with the license you may obtain a copy of the
        license at [[((http | https))]] www apache org licenses license 2 0 [[{{1}} html]] unless required by applicable law or agreed to in writing software distributed
        under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
        language governing permissions and limitations under the license"""),
    ("gpl", """free software you can redistribute it and or modify it under the terms of [[version {{1}} of]] the gnu [[((lesser | affero | library))]] general public license
        as published by the free software foundation ((either version {{2}} of the license or at your option any later version | version {{2}} of the license))
        [[ {{6}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
        particular purpose see the gnu [[((lesser | affero | library))]] general public license for more details ]]"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of
        this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
        subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if
        you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be
        plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
        either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at
        [[((http | https))]] ((mozilla org | www mozilla org)) mpl 2 0"""),
]
#: Wording of clauses that name a licence.
CLAUSES = [
    ("mit", "under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of {{6}} and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "under the [[terms of the]] apache license version 2 [[0]] [[the license]]"),
    ("apache-2", "you may not use {{4}} except in compliance with the license"),
    ("cc-by-nc", "cc by nc [[{{1}} 0]]"),
    ("cc-by-nc", "creative commons attribution noncommercial [[{{1}} 0]] [[international]] [[license]]"),
    ("cc-by", "licensed under a creative commons attribution {{2}} international license"),
    ("gpl", "under the terms of the gnu [[lesser]] [[affero]] general public license [[as published by the free software foundation]]"),
    ("gpl", "licensed under the gnu [[lesser]] [[affero]] general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 [[0]]"),
    ("proprietary", "all rights reserved"),
]
TEMPLATES = WHOLE + CLAUSES
#: Opening words of a template that must be literal.
OPENING = 2


class Automaton:
    """States of a template: words to follow, states reached without a word, and regions of any word."""

    def __init__(self, template: str):
        self.word: list[int | None] = []
        self.free: list[list[int]] = []
        tokens = re.findall(r"\[\[|\]\]|\(\(|\)\)|\||\{\{\d+\}\}|[^\s\[\](){}|]+", template)
        opened: list[int] = []
        choices: list[tuple[int, list[int]]] = []
        lead: list[int] = []
        leading = True
        for t in tokens:
            if t == "[[":
                leading = False
                opened.append(self._state(None, []))
                self.free[-1].append(len(self.word))
            elif t == "]]":
                at = self._state(None, [])
                self.free[at].append(at + 1)
                self.free[opened.pop()].append(at)
            elif t == "((":
                leading = False
                at = self._state(None, [])
                self.free[at].append(at + 1)
                choices.append((at, []))
            elif t == "|":
                start, ends = choices[-1]
                ends.append(self._state(None, []))
                self.free[start].append(len(self.word))
            elif t == "))":
                for at in choices.pop()[1]:
                    self.free[at].append(len(self.word))
            elif t.startswith("{{"):
                leading = False
                n = int(t[2:-2])
                end = len(self.word) + n
                for _ in range(n):
                    self._state(-1, [end])
            else:
                h = fixed_hash(t)
                self._state(h, [])
                if leading:
                    lead.append(h)
        if len(lead) < OPENING:
            raise ValueError(f"a template opens with {OPENING} words: {template}")
        self.lead = lead

    def _state(self, word: int | None, free: list[int]) -> int:
        self.word.append(word)
        self.free.append(free)
        return len(self.word) - 1

    def _reach(self, states: set[int]) -> set[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.free[s] if s < len(self.word) else []
        return out

    def match(self, h: list[int]) -> tuple[int, int]:
        """Words that the longest accepted passage from the start of ``h`` has, and how many of them stand in the template; (0, 0) for none."""
        end, best = len(self.word), (0, 0)
        states = {s: 0 for s in self._reach({0})}
        for i, x in enumerate(h):
            after: dict[int, int] = {}
            for s, literal in states.items():
                if s < end and self.word[s] is not None and self.word[s] in (x, -1):
                    for r in self._reach({s + 1}):
                        after[r] = max(after.get(r, -1), literal + (self.word[s] != -1))
            if not after:
                break
            if end in after:
                best = (i + 1, after[end])
            states = after
        return best

    @property
    def longest(self) -> int:
        return len(self.word)


def _places(h: np.ndarray, doc: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Word positions where the hashes of a phrase follow each other in one document."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[:n] == U(phrase[0]))
    for j, x in enumerate(phrase[1:], 1):
        at = at[h[at + j] == U(x)]
    return at[doc[at] == doc[at + len(phrase) - 1]]


MATCH = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """id, ``n_words`` and ``matches`` (label, start and end word, base, score), by start.

    Base matches are the places of phrases, score 1. Others are passages that a
    template accepts; their score is the share of words that stand in the
    template. Null or empty texts have no words and no matches; repeated rows
    are scanned alike; other columns are not read.
    """
    phrases = {k: [fixed_hash(w) for w in v.split()] for k, v in (PHRASES if phrases is None else phrases).items()}
    automata = [(label, Automaton(t)) for label, t in (TEMPLATES if templates is None else templates)]
    field = docs.schema[id_col]

    def run(batches):
        for rows, data, off in slices(batches, "_text"):
            n = rows.num_rows
            start, end, doc = words(data, off, ALNUM_WORD)
            h = spans_hash(eights(data, True), start, end)
            first = np.searchsorted(doc, np.arange(n + 1))
            found: list[list[dict]] = [[] for _ in range(n)]
            for label, phrase in phrases.items():
                for p in _places(h, doc, phrase):
                    d, k = doc[p], int(p - first[doc[p]])
                    found[d].append({"label": label, "start": k, "end": k + len(phrase), "base": True, "score": 1.0})
            for label, a in automata:
                for p in _places(h, doc, a.lead):
                    d = doc[p]
                    size, literal = a.match(h[p : min(first[d + 1], p + a.longest)].tolist())
                    if size:
                        k = int(p - first[d])
                        found[d].append({"label": label, "start": k, "end": k + size, "base": False, "score": literal / size})
            for x in found:
                x.sort(key=lambda m: (m["start"], m["end"], m["label"], m["base"]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(first)), pa.array(found, pa.list_(MATCH))], [id_col, "n_words", "matches"])

    schema = f"`{id_col}` {field.dataType.simpleString()}, n_words long, matches array<struct<label:string,start:long,end:long,base:boolean,score:double>>"
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and labels per document over rows of :func:`scan`."""
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
