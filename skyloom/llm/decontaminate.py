"""Training documents that hold benchmark items, also edited ones.

Rare word n-grams of the items are seeds. A seed is rare if the product of its
words' shares of the whole corpus is small, so that chance alone hardly brings
it about; leaked copies of an item, however many, do not make it common. An
item with few rare n-grams has its rarest as seeds; an item of one or two words
is its own seed, and matches exactly. Seeds join the n-grams of documents;
where a document holds a seed, the words around it are aligned with the item by
Smith-Waterman.

Items, words and seeds are tables, so any number of items can be given. What
goes to every task whatever their number is two bitmaps of 2 MB, which drop
most words and n-grams that no item has before they are shuffled. Equal texts,
and items of equal words, are aligned once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.scratch import written
from skyloom.llm.textops import ALNUM_WORD, U, eights, slices, spans_hash, windows, words

GRAM = 3
RARE = 1e-7
LEAST_SEEDS = 5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Up to so many rows of a side are sent to every task; beyond, the join shuffles.
FEW = 500_000
#: Items whose words stand in one row beside a text.
TOGETHER = 64
_BITS = 24
KEY = ["k1", "k2"]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _keyed(df: DataFrame, text_col: str, *names: str) -> DataFrame:
    """``df`` with a 128-bit key of each row's text, null texts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(*names, F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("_text"))


def _word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, doc = words(data, off, ALNUM_WORD)
    return spans_hash(eights(data, True), start, end), doc


def item_words(items: DataFrame) -> DataFrame:
    """(k1, k2, words): the hashes of each different item's words; items without a word are left out."""

    def run(batches):
        for rows, data, off in slices(batches, "_text"):
            h, doc = _word_hashes(data, off)
            first = np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.ListArray.from_arrays(pa.array(first), pa.array(h.view(np.int64)))], [*KEY, "words"])

    return items.select(*KEY, "_text").dropDuplicates(KEY).mapInArrow(run, "k1 long, k2 long, words array<long>").filter(F.size("words") > 0)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Which upper 24 bits the hashes of a column ``h`` have. 2 MB, whatever their number."""
    top = F.shiftrightunsigned("h", 64 - _BITS)
    bit = F.bit_or(F.expr("shiftleft(1L, cast(top % 64 as int))"))
    rows = hashes.select(top.alias("top")).groupBy((F.col("top") / 64).cast("long").alias("word")).agg(bit.alias("bits")).collect()
    out = np.zeros(1 << (_BITS - 6), np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out.view(U)


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    top = h >> U(64 - _BITS)
    return (bits[(top >> U(6)).astype(np.int64)] >> (top & U(63))) & U(1) == 1


def word_shares(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(h, share): the share of all words of the corpus (``_text``) that each word of the vocabulary (h) has; words that never occur are left out."""
    bits = bitmap(vocabulary)

    def run(batches):
        for _, data, off in slices(batches, "_text"):
            h, _ = _word_hashes(data, off)
            some, n = np.unique(h[_known(bits, h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)).cast(pa.int64()), pa.array(n), pa.array(np.zeros(len(some), np.int64))], ["h", "n", "total"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([len(h)])], ["h", "n", "total"])

    counts = written(docs.select("_text").mapInArrow(run, "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "words")
    total = counts.filter("h is null").agg(F.max("total")).first()[0] or 1
    return counts.join(_small(vocabulary), "h").select("h", (F.col("n") / total).alias("share"))


def seed_rows(items: DataFrame, shares: DataFrame, rare: float) -> DataFrame:
    """(g, size, place, i1, i2, length): each seed's hash and number of words, its place in the item, the item's key and number of words."""
    at = items.select(*KEY, F.posexplode("words").alias("at", "h")).join(_small(shares), "h", "left")
    chances = at.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("share", F.lit(0.0)).alias("share")))), lambda x: x["share"]).alias("shares"))

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for k1, k2, ws, ps in zip(*(b.column(i) for i in range(4)), strict=True):
                h = ws.values.to_numpy().view(U)
                size = min(GRAM, len(h))
                g, place = windows(h, np.zeros(len(h), np.int64), size)
                p = np.maximum(ps.values.to_numpy(), 1e-12)
                chance = np.prod([p[j : len(p) - size + 1 + j] for j in range(size)], axis=0)
                keep = chance <= max(rare, np.sort(chance)[min(LEAST_SEEDS, len(chance)) - 1])
                n = int(keep.sum())
                for column, values in zip(out, (g[keep].view(np.int64).tolist(), [size] * n, place[keep].tolist(), [k1.as_py()] * n, [k2.as_py()] * n, [len(h)] * n), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["g", "size", "place", "i1", "i2", "length"])

    return items.join(chances, KEY).select(*KEY, "words", "shares").mapInArrow(run, "g long, size long, place long, i1 long, i2 long, length long")


def seed_hits(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(k1, k2, g, size, at): n-grams of documents that may be seeds, and the word at which each starts."""

    def run(batches):
        for rows, data, off in slices(batches, "_text"):
            h, doc = _word_hashes(data, off)
            first = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            for size in sizes:
                g, at = windows(h, doc, size)
                hope = _known(bits, g)
                g, at = g[hope], at[hope]
                d = doc[at]
                keys = [rows.column(i).take(pa.array(d)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(g.view(np.int64)), pa.array(np.full(len(g), size)), pa.array(at - first[d])], [*KEY, "g", "size", "at"])

    return docs.select(*KEY, "_text").mapInArrow(run, "k1 long, k2 long, g long, size long, at long")


def align(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of pairs of word sequences (rows, padded with 0), and where in the text each ends."""
    n, width = texts.shape
    steps = np.arange(width) * -GAP
    h = np.zeros((n, width), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        x = items[:, i : i + 1]
        gain = np.where((x == texts) & (x != 0), MATCH, MISMATCH)
        diagonal = np.zeros_like(h)
        diagonal[:, 1:] = h[:, :-1]
        row = np.maximum(np.maximum(diagonal + gain, h + GAP), 0)
        h = np.maximum.accumulate(row + steps, axis=1) - steps
        h[x[:, 0] == 0] = 0
        top = h.max(1)
        better = top > best
        end[better] = h[better].argmax(1)
        best[better] = top[better]
    return best, end


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), U)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _best(h: np.ndarray, entries: list[dict], threshold: float) -> list[tuple]:
    """(entry, share, first word, last word) of the items that align well with a text's words around their seeds; the best passage of each, the first on ties."""
    spans: list[list[int]] = []
    for e, entry in enumerate(entries):
        size = len(entry["words"])
        slack = size // 2 + 2 if size >= GRAM else 0
        for begin in sorted(entry["begins"]):
            a, b = max(begin - slack, 0), min(begin + size + slack, len(h))
            if spans and spans[-1][0] == e and a <= spans[-1][2]:
                spans[-1][2] = max(spans[-1][2], b)
            else:
                spans.append([e, a, b])
    spans.sort(key=lambda s: s[2] - s[1])
    texts = [np.array(x["words"], np.int64).view(U) for x in entries]
    best: dict[int, tuple] = {}
    at = 0
    while at < len(spans):
        to = at + 1
        while to < len(spans) and (to + 1 - at) * (spans[to][2] - spans[to][1]) <= 1 << 18:
            to += 1
        part = spans[at:to]
        score, stop = align(_padded([texts[e] for e, _, _ in part]), _padded([h[a:b] for _, a, b in part]))
        full = np.array([MATCH * len(texts[e]) for e, _, _ in part])
        good = np.flatnonzero(np.where(full < MATCH * GRAM, score == full, score >= threshold * full)).tolist()
        if good:
            back = [part[i] for i in good]
            _, head = align(_padded([texts[e][::-1] for e, _, _ in back]), _padded([h[a : a + stop[i] + 1][::-1] for i, (_, a, _) in zip(good, back, strict=True)]))
            for i, (e, a, _), length in zip(good, back, head.tolist(), strict=True):
                end = a + int(stop[i])
                row = (-float(score[i] / full[i]), end - length, end)
                best[e] = min(best.get(e, row), row)
        at = to
    return [(e, -row[0], row[1], row[2]) for e, row in sorted(best.items())]


def aligned(passages: DataFrame, threshold: float) -> DataFrame:
    """(k1, k2, i1, i2, score, first_word, last_word) of rows with a text and the items whose seeds it holds."""

    def run(batches):
        for rows, data, off in slices(batches, "_text"):
            h, doc = _word_hashes(data, off)
            first = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            entries = rows.column(3)
            out: list[list] = [[] for _ in range(7)]
            for r in range(rows.num_rows):
                mine = entries[r].as_py()
                for e, *found in _best(h[first[r] : first[r + 1]], mine, threshold):
                    for column, v in zip(out, (rows.column(0)[r].as_py(), rows.column(1)[r].as_py(), mine[e]["i1"], mine[e]["i2"], *found), strict=True):
                        column.append(v)
            kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], [*KEY, "i1", "i2", "score", "first_word", "last_word"])

    return passages.select(*KEY, "_text", "entries").mapInArrow(run, "k1 long, k2 long, i1 long, i2 long, score double, first_word long, last_word long")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rare: float = RARE) -> DataFrame:
    """id, item id, ``score``, ``first_word``, ``last_word``: one row for each document and item that align well.

    ``score`` is the alignment's score over that of the whole item, at least
    ``threshold``; words count from 0, as runs of letters, digits and non-ASCII
    characters, ASCII letters lower-cased. Items of one or two words must stand
    in a text exactly. Texts that are null, empty or without words match
    nothing. Repeated documents and items are reported as often as they occur;
    ids may be of any type, null included. Of several passages that match one
    item the best is given, the first on ties. Other columns are not read. The
    two id columns need different names.
    """
    if id_col == item_col:
        raise ValueError(f"documents and items both have their id in {id_col!r}")
    texts = _keyed(docs, text_col, id_col)
    bench = _keyed(items, item_text, item_col)
    known = written(item_words(bench), "items")
    vocabulary = written(known.select(F.explode("words").alias("h")).distinct(), "vocabulary")
    seeds = written(seed_rows(known, word_shares(texts, vocabulary), rare), "seeds")
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())
    hits = written(seed_hits(texts, bitmap(seeds.select(F.col("g").alias("h"))), sizes).join(_small(seeds), ["g", "size"]).select(*KEY, "i1", "i2", (F.col("at") - F.col("place")).alias("begin")), "hits")
    begins = hits.groupBy(*KEY, "i1", "i2").agg(F.collect_set("begin").alias("begins"))
    own = known.select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), "words")
    part = F.pmod(F.xxhash64("i1"), F.greatest(F.ceil(F.col("n") / TOGETHER), F.lit(1)))
    number = hits.groupBy(*KEY).agg(F.count_distinct("i1", "i2").alias("n"))
    entries = begins.join(number, KEY).withColumn("part", part).join(_small(own), ["i1", "i2"]).groupBy(*KEY, "part").agg(F.collect_list(F.struct("i1", "i2", "words", "begins")).alias("entries"))
    entries = written(entries, "entries")
    ids = entries.select(*KEY).distinct()
    few = ids.limit(FEW + 1).count() <= FEW
    held = texts.select(*KEY, "_text").join(F.broadcast(ids), KEY, "left_semi") if few else texts.select(*KEY, "_text")
    found = aligned(held.dropDuplicates(KEY).join(entries, KEY), threshold).dropDuplicates([*KEY, "i1", "i2"])
    found = written(found, "found")
    named = bench.select(item_col, F.col("k1").alias("i1"), F.col("k2").alias("i2"))
    out = texts.select(id_col, *KEY).join(_small(found), KEY).join(_small(named), ["i1", "i2"])
    return out.select(id_col, item_col, "score", "first_word", "last_word")
