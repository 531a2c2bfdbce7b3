"""Languages of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

Model: for each language, log probabilities of hashed byte trigrams of words
(word ends included), and the scripts in which its words are written. Both are
sums over the training rows, made per task and added up by Spark; what reaches
the driver has a fixed size (languages x ``CELLS``), whatever the corpus.

Labelling: a word's candidates are all languages seen in its script, however rarely; over the
candidates' scores Viterbi finds the best sequence, each change of language
costing ``SWITCH`` nats. Runs of one language are the spans of a text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import sums as sums_of
from skyloom.llm.textops import LETTER, slices, words

BITS = 14
CELLS = 1 << BITS
SWITCH = 12.0
#: Words of a document beyond which it is labelled in blocks.
LONG = 4096
#: UTF-8 lead bytes of script ranges, in order; the highest in a word decides. Fixed values of Unicode's block layout.
SCRIPTS = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCB)], "greek": [0xCE, 0xCF], "cyrillic": [*range(0xD0, 0xD4)], "armenian_hebrew": [*range(0xD4, 0xD8)], "arabic": [*range(0xD8, 0xDC)], "indic": [0xE0], "kana": [0xE3], "han": [*range(0xE4, 0xEA)], "hangul": [*range(0xEA, 0xEE)], "other": [0xE1, 0xE2, *range(0xF0, 0xF5)]}
_SCRIPT = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(SCRIPTS.values()):
    _SCRIPT[_bytes] = _i
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[0x41:0x5B] += 32


@dataclass
class Model:
    """languages, sorted; log probabilities [CELLS, languages]; candidates [scripts, languages]."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Trigram cells of all words in one array, and where each word's begin."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - start, size)
    low = _LOWER[data]
    here = low[at]
    left = low[np.maximum(at - 1, 0)]
    left[first[:-1][size > 0]] = 32
    right = low[np.minimum(at + 1, len(low) - 1)]
    right[(first[1:] - 1)[size > 0]] = 32
    code = (left << np.uint32(16)) | (here << np.uint32(8)) | right
    code *= np.uint32(2654435761)
    return code >> np.uint32(32 - BITS), first


def _scripts(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(_SCRIPT[data], start) if len(start) else np.zeros(0, np.uint8)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows with a non-null language. Null texts teach nothing; no rows give a model without languages."""
    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for rows, data, off in slices(batches, "_text"):
            start, end, doc = words(data, off, LETTER)
            if not len(start):
                continue
            cells, first = _grams(data, start, end)
            scripts = _scripts(data, start)
            coded = rows.column(rows.schema.get_field_index("_lang")).dictionary_encode()
            langs = coded.indices.to_numpy(zero_copy_only=False)[doc]
            for code, lang in enumerate(coded.dictionary.to_pylist()):
                mine = langs == code
                if lang not in sums:
                    sums[lang] = np.zeros(CELLS + len(SCRIPTS))
                sums[lang][:CELLS] += np.bincount(cells[np.repeat(mine, np.diff(first))], minlength=CELLS)
                sums[lang][CELLS:] += np.bincount(scripts[mine], minlength=len(SCRIPTS))
        yield sums_of.batch({f"{x}/{k}": sums[x][k : k + 1024] for x in sums for k in range(0, CELLS + len(SCRIPTS), 1024)})

    parts = sums_of.add_up(known.mapInArrow(count, sums_of.SCHEMA))
    languages = sorted({key.rpartition("/")[0] for key in parts})
    raw = np.zeros((CELLS + len(SCRIPTS), len(languages)))
    for key, part in parts.items():
        lang, _, k = key.rpartition("/")
        raw[int(k) : int(k) + len(part), languages.index(lang)] += part
    grams, scripts = raw[:CELLS], raw[CELLS:]
    weights = np.log((grams + 0.1) / (grams + 0.1).sum(0)).astype(np.float32)
    allowed = scripts > 0
    allowed[~allowed.any(1)] = True
    return Model(languages, weights, allowed)


def _forward(scores: np.ndarray, first: np.ndarray, size: np.ndarray, before: np.ndarray, switch: float, choice: np.ndarray | None) -> np.ndarray:
    """Best values by label after the last word of each run of words, from those before its first; into ``choice``, where each value came from.

    All runs advance together, longest first, so a step costs one array
    operation over the runs that still have words.
    """
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    best = before[order].astype(float)
    labels = np.arange(scores.shape[1])
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")
    for t in range(longest):
        a = alive[t]
        at = first[:a] + t
        top = best[:a].argmax(1)
        jump = best[np.arange(a), top][:, None] - switch
        moved = jump > best[:a]
        if choice is not None:
            choice[at] = np.where(moved, top[:, None], labels)
        best[:a] = np.where(moved, jump, best[:a]) + scores[at]
    out = np.empty_like(best)
    out[order] = best
    return out


def _backward(choice: np.ndarray, first: np.ndarray, size: np.ndarray, last: np.ndarray, out: np.ndarray) -> None:
    """Label of each word of each run, from the label of its last."""
    order = np.argsort(-size, kind="stable")
    first, size, now = first[order], size[order], last[order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")
    left = size.copy()
    for t in range(longest):
        a = alive[t]
        left[:a] -= 1
        at = first[:a] + left[:a]
        out[at] = now[:a]
        now[:a] = choice[at, now[:a]]


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word. scores: [words, labels]; bounds: first word of each document, and the end.

    A document of more than LONG words is cut into blocks of about the root of
    its length. The best values of a block from each label before it, for all
    blocks at once, give by one pass over blocks the labels at their ends; so
    the steps are as many as the root of the longest document's words.
    """
    n_labels = scores.shape[1]
    kind = np.uint8 if n_labels <= 256 else np.int32
    out = np.zeros(len(scores), kind)
    if not len(scores):
        return out
    first, size, doc = [], [], []
    for d, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        step = z - a if z - a <= LONG else max(1, math.isqrt(z - a))
        for x in range(a, z, max(step, 1)):
            first.append(x)
            size.append(min(step, z - x))
            doc.append(d)
    first, size, doc = np.array(first), np.array(size), np.array(doc)
    head = np.append(True, doc[1:] != doc[:-1])
    before = np.zeros((len(first), n_labels))
    end = np.full(len(first), -1)
    cut = np.flatnonzero(~head | np.append(~head[1:], False))
    if len(cut):
        known = np.full((n_labels, n_labels), -1e30)
        np.fill_diagonal(known, 0.0)
        through = _forward(scores, np.repeat(first[cut], n_labels), np.repeat(size[cut], n_labels), np.tile(known, (len(cut), 1)), switch, None).reshape(len(cut), n_labels, n_labels)
        value, came = np.zeros(n_labels), np.zeros((len(cut), n_labels), np.int64)
        for i, r in enumerate(cut.tolist()):
            total = (np.zeros(n_labels) if head[r] else value)[:, None] + through[i]
            came[i], value = total.argmax(0), total.max(0)
            if i + 1 == len(cut) or head[cut[i + 1]]:
                end[r] = value.argmax()
        for i in range(len(cut) - 1, -1, -1):
            if not head[cut[i]]:
                before[cut[i]] = known[came[i, end[cut[i]]]]
                end[cut[i - 1]] = came[i, end[cut[i]]]
    choice = np.zeros(scores.shape, kind)
    best = _forward(scores, first, size, before, switch, choice)
    _backward(choice, first, size, np.where(end < 0, best.argmax(1), end), out)
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """id, kept columns, ``lang_pred``, ``score`` and, if asked, ``spans`` (start byte, end byte, language).

    ``lang_pred`` has the most letters of the text (characters, not bytes);
    ``score`` is their share.
    Texts that are null or have no letter, and any text under a model without
    languages, are ``und`` with score 0 and no spans. Ties go to the language
    first in order. Repeated rows are judged alike.
    """
    fields = [f for f in docs.schema.fields if f.name in {id_col, *(keep or [])}]
    names = [f.name for f in fields]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    table = model.languages
    weights, allowed = model.weights, model.allowed

    def run(batches):
        for rows, data, off in slices(batches, "_text"):
            n = rows.num_rows
            pred, score, found = np.full(n, "und", object), np.zeros(n), [[] for _ in range(n)]
            start, end, doc = words(data, off, LETTER)
            lettered = _has_letter(data, off)
            if len(start) and table:
                cells, first = _grams(data, start, end)
                marks = np.add.reduceat(weights[cells], first[:-1], axis=0)
                marks[~allowed[_scripts(data, start)]] -= 1e4
                bounds = np.searchsorted(doc, np.arange(n + 1))
                label = viterbi(marks, bounds)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                weight = np.bincount(doc * len(table) + label, weights=chars[end] - chars[start], minlength=n * len(table)).reshape(n, len(table))
                total = weight.sum(1)
                has = (total > 0) & lettered
                pred[has] = np.array(table, object)[weight.argmax(1)[has]]
                score[has] = weight.max(1)[has] / total[has]
                if spans:
                    new = np.ones(len(label), bool)
                    new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                    begin = np.flatnonzero(new)
                    last = np.append(begin[1:], len(label)) - 1
                    for b, e in zip(begin, last, strict=True):
                        if has[d := doc[b]]:
                            found[d].append({"start": int(start[b] - off[d]), "end": int(end[e] - off[d]), "lang": table[label[b]]})
            cols = [*(rows.column(rows.schema.get_field_index(x)) for x in names), pa.array(pred.tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(found, kind)] if spans else [])], [*names, "lang_pred", "score", *(["spans"] if spans else [])])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double", *(["spans array<struct<start:long,end:long,lang:string>>"] if spans else [])])
    return docs.select(*names, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def _has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a text has a Unicode letter. Only texts without an ASCII letter need decoding."""
    ascii_letter = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 0x80))])
    out = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace"))
    return out
