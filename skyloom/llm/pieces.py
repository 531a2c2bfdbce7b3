"""SentencePiece BPE encoding by suffix-array matching, and decoding.

A slice of documents is cut into words, wherever two characters meet that no
piece has side by side. Its distinct words are concatenated and their suffixes
sorted; a binary search for every piece of the vocabulary gives the ranges of
its occurrences. These are edges of a lattice; sorted by where they end, they
are relaxed for all words together.

A BPE vocabulary has no path costs. An edge is relaxed when its piece may
follow the last piece of the best path to its start: two pieces may stand side
by side if merging their joined characters, best-ranked pair first, gives back
these two. For each position exactly one piece satisfies this, so the path is
the encoding that merging gives. Characters without a piece become byte pieces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.textops import U, eights, mix, same_bytes, slices, spans_hash

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SPACE_BYTES = SPACE.encode()
SLICE = 1 << 19
NONE = np.int32(1 << 30)
_CACHE_BITS = 20


class Vocabulary:
    """Tables of a BPE model, pieces numbered by rank: single characters, then merges from best to worst.

    ids: the model's id of each; text and length: bytes, a space for U+2581;
    left, right: the two pieces last merged into a piece (itself for a single
    character); joins: (left, right) pairs that merge, packed and sorted, and
    what they merge into. byte_ids: ids of the 256 byte pieces.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rank: list[tuple] = []
        self.byte_ids = np.zeros(256, np.int32)
        self.size = model.get_piece_size()
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                spaces = set(piece) == {SPACE}
                rank.append((len(piece) > 1, spaces, len(piece) if spaces else 0, -model.get_score(i), i, piece))
        rank.sort()
        number = {r[-1]: k for k, r in enumerate(rank)}
        n = len(rank)
        left, right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        reached = np.ones(n, bool)
        for piece, k in number.items():
            parts = list(piece)
            while len(parts) > 1:
                best = min((number.get(a + b, NONE), j) for j, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] == NONE:
                    break
                j = best[1]
                pair = parts[j : j + 2]
                parts[j : j + 2] = ["".join(pair)]
            if len(parts) > 1:
                reached[k] = False
            elif len(piece) > 1:
                if not all(x in number for x in pair):
                    raise ValueError("a piece is merged from a character that is no piece")
                left[k], right[k] = number[pair[0]], number[pair[1]]
        joins = sorted((number[p[:j]] * (1 << 32) + number[p[j:]], k) for p, k in number.items() for j in range(1, len(p)) if p[:j] in number and p[j:] in number)
        self.left, self.right = left, right
        self.join_keys, self.join_to = np.array([j[0] for j in joins], np.int64), np.array([j[1] for j in joins], np.int32)
        self.ids = np.array([r[-2] for r in rank], np.int32)
        self.texts = [r[-1].replace(SPACE, " ").encode() for r in rank]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.reached = reached
        runs = [k for k, r in enumerate(rank) if r[1]] + [number[SPACE]]
        self.is_spaces = np.zeros(n + 1, bool)
        self.is_spaces[runs] = True
        self.longest_run = max(runs, key=lambda k: self.length[k])
        order = np.argsort(self.ids)
        blob = [b""] * self.size
        for k in order:
            blob[self.ids[k]] = self.texts[k]
        for b, i in enumerate(self.byte_ids):
            blob[i] = bytes([b])
        self.out_blob = np.frombuffer(b"".join(blob), np.uint8)
        self.out_off = np.concatenate([[0], np.cumsum([len(x) for x in blob])]).astype(np.int64)
        self.inside = np.zeros(1 << 16, bool)
        for t in self.texts:
            b = np.frombuffer(t, np.uint8).astype(np.uint16)
            self.inside[(b[:-1] << 8) | b[1:]] = True
        self._search_tables()

    def _search_tables(self) -> None:
        """Pieces by length, as big-endian numbers of their first and second eight bytes."""
        pad = [t[:16].ljust(16, b"\0") for t in self.texts]
        raw = np.frombuffer(b"".join(pad), ">u8").reshape(-1, 2).astype(U)
        self.first, self.second = raw[:, 0].copy(), raw[:, 1].copy()

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay as they are when their characters are merged together."""
        out = np.ones(len(a), bool)
        both = self.is_spaces[a] & self.is_spaces[b]
        out[both] = a[both] == self.longest_run
        live = np.flatnonzero(~both)
        x, y = a[live].astype(np.int64), b[live].astype(np.int64)
        limit = np.full(len(live), int(NONE), np.int64)
        while len(live):
            key = (x << 32) + y
            at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
            merged = np.where(self.join_keys[at] == key, self.join_to[at], NONE)
            bad = merged < limit
            out[live[bad]] = False
            go = ~bad
            live, x, y, limit = live[go], x[go], y[go], limit[go]
            x_base, y_base = self.right[x] == x, self.left[y] == y
            done = x_base & y_base
            live, x, y, limit, x_base, y_base = (v[~done] for v in (live, x, y, limit, x_base, y_base))
            cut_x = ((x > y) & ~x_base) | y_base
            limit = np.where(cut_x, x, y + 1)
            x, y = np.where(cut_x, self.right[x], x), np.where(cut_x, y, self.left[y])
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    return Vocabulary(path)


class _Pairs:
    """Remembers which pieces may stand side by side."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.key = np.full(1 << _CACHE_BITS, -1, np.int64)
        self.value = np.zeros(1 << _CACHE_BITS, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) + b
        slot = ((key.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - _CACHE_BITS)).astype(np.int64)
        out = self.value[slot]
        miss = np.flatnonzero(self.key[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            found = self.v.beside(new >> 32, new & 0xFFFFFFFF)
            out[miss] = found[back]
            self.key[slot[miss]], self.value[slot[miss]] = key[miss], out[miss]
        return out


def _suffixes(text: np.ndarray, at: np.ndarray):
    """Places ``at`` in the order of their first 16 bytes, and these bytes as two numbers."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words8 = np.zeros(len(text) + 9, U)
    for j in range(8):
        words8 |= padded[j : j + len(text) + 9].astype(U) << U(8 * (7 - j))
    one, two = words8[at], words8[np.minimum(at + 8, len(words8) - 1)]
    order = np.argsort(one)
    one, two, at = one[order], two[order], at[order]
    tied = np.zeros(len(one) + 1, bool)
    tied[1:-1] = one[1:] == one[:-1]
    tied = np.flatnonzero(tied[1:] | tied[:-1])
    order = tied[np.lexsort((two[tied], one[tied]))]
    two[tied], at[tied] = two[order], at[order]
    return at, one, two


def _edges(v: Vocabulary, text: np.ndarray, at: np.ndarray):
    """(place, piece) of every occurrence of every piece that merging can make."""
    sa, one, two = _suffixes(text, at)
    size = v.length
    fill = np.where(size < 8, (np.uint64(1) << (U(8) * (U(8) - np.minimum(size, 8).astype(U)))) - U(1), U(0))
    lo = np.searchsorted(one, v.first, "left")
    hi = np.searchsorted(one, v.first | fill, "right")
    lo[~v.reached] = hi[~v.reached] = 0
    raw = text.tobytes()
    extra_at, extra_piece = [], []
    for k in np.flatnonzero((size > 8) & (hi > lo)):
        a, b = lo[k], hi[k]
        tail = U((1 << (8 * (16 - int(size[k])))) - 1) if size[k] < 16 else U(0)
        a, b = a + np.searchsorted(two[a:b], v.second[k], "left"), a + np.searchsorted(two[a:b], v.second[k] | tail, "right")
        if size[k] > 16 and b > a:
            fits = [p for p in sa[a:b].tolist() if raw.startswith(v.texts[k], p)]
            extra_at += fits
            extra_piece += [k] * len(fits)
            a = b
        lo[k], hi[k] = a, b
    count = hi - lo
    piece = np.repeat(np.arange(len(size), dtype=np.int32), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    place = sa.astype(np.int32)[np.arange(len(piece), dtype=np.int32) - np.repeat((first - lo).astype(np.int32), count)]
    return np.concatenate([place, np.array(extra_at, np.int32)]), np.concatenate([piece, np.array(extra_piece, np.int32)])


def encode_words(v: Vocabulary, pairs: _Pairs, text: np.ndarray, begin: np.ndarray):
    """Model ids of each word. text: words, each followed by a byte 255; begin: where each begins, and the end of text."""
    n_words = len(begin) - 1
    chars = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 255))
    place, piece = _edges(v, text, chars)
    known = np.zeros(len(text), bool)
    edges = np.flatnonzero((text & 0xC0) != 0x80)
    char_size = np.zeros(len(text), np.int32)
    char_size[edges] = np.diff(np.append(edges, len(text)))
    unknown = len(v.length)
    length = np.append(v.length, 0).astype(np.int32)
    known[place[char_size[place] == length[piece]]] = True
    strange = chars[~known[chars]].astype(np.int32)
    place, piece = np.concatenate([place, strange]), np.concatenate([piece, np.full(len(strange), unknown, np.int32)])
    size = length[piece]
    size[len(size) - len(strange) :] = char_size[strange]
    head = np.repeat(begin[:-1].astype(np.int32), np.diff(begin))[place]
    steps = place + size - head
    order = np.argsort(steps.astype(np.uint16) if len(steps) and steps.max() < 1 << 16 else steps, kind="stable")
    place, piece, steps = place[order], piece[order], steps[order]
    opening = place == head[order]
    stop = place + size[order]
    bounds = np.append(np.flatnonzero(np.diff(steps, prepend=-1)), len(steps))
    last, came = np.full(len(text) + 1, -1, np.int32), np.zeros(len(text) + 1, np.int32)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        p, q = place[a:b], piece[a:b]
        before = last[p]
        ok = opening[a:b] | ((before == unknown) | ((q == unknown) & (before >= 0)))
        test = np.flatnonzero(~ok & (before >= 0))
        if len(test):
            ok[test] = pairs(before[test], q[test])
        at = stop[a:b][ok]
        last[at], came[at] = q[ok], p[ok]
    at = begin[1:] - 1
    live = np.arange(n_words)
    got_word, got_piece, got_from = [], [], []
    while len(live):
        got_word.append(live)
        got_piece.append(last[at])
        at = came[at]
        got_from.append(at)
        more = at > begin[live]
        live, at = live[more], at[more]
    w, p, f = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (got_word, got_piece, got_from))
    order = np.lexsort((f, w))
    w, p, f = w[order], p[order], f[order]
    size = np.where(p == unknown, char_size[f], 1)
    start = np.concatenate([[0], np.cumsum(size)])
    ids = np.repeat(v.ids[np.minimum(p, unknown - 1)], size)
    odd = np.repeat(p == unknown, size)
    ids[odd] = v.byte_ids[text[(np.repeat(f - start[:-1], size) + np.arange(len(ids)))[odd]]]
    return ids, np.concatenate([[0], np.cumsum(np.bincount(w, weights=size, minlength=n_words))]).astype(np.int64)


def _spaced(data: np.ndarray, off: np.ndarray):
    """Each non-empty text with a space before it and U+2581 as a space; one array and offsets."""
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    texts = [b" " + t.replace(SPACE_BYTES, b" ") if t else b"" for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _encode_slice(v: Vocabulary, pairs: _Pairs, data: np.ndarray, off: np.ndarray):
    """Ids of all documents in one array, and where each begins."""
    text, bounds = _spaced(data, off)
    n = len(bounds) - 1
    if not len(text):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    head = (text & 0xC0) != 0x80
    head[1:] &= ~v.inside[(text[:-1].astype(np.uint16) << 8) | text[1:]]
    head[bounds[:-1][bounds[:-1] < len(text)]] = True
    start = np.flatnonzero(head)
    stop = np.append(start[1:], len(text))
    view = eights(text, False)
    _, first, back = np.unique(spans_hash(view, start, stop), return_index=True, return_inverse=True)
    other = np.flatnonzero((stop - start != (stop - start)[first][back]) | ~same_bytes(view, start, start[first][back], stop - start))
    back[other] = len(first) + np.arange(len(other))  # words of one hash that are not the same
    first = np.concatenate([first, other])
    size = stop[first] - start[first] + 1
    begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    source = np.arange(begin[-1]) - np.repeat(begin[:-1] - start[first], size)
    joined = text[np.minimum(source, len(text) - 1)]
    joined[begin[1:] - 1] = 255
    ids, at = encode_words(v, pairs, joined, begin)
    count = np.diff(at)[back]
    total = np.concatenate([[0], np.cumsum(count)])
    every = ids[np.arange(total[-1]) - np.repeat(total[:-1] - at[:-1][back], count)]
    return every, total[np.searchsorted(start, bounds)]


def _decode_slice(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Text of each list of ids; ids lie within the model."""
    size = v.out_off[ids + 1] - v.out_off[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    raw = v.out_blob[np.arange(total[-1]) - np.repeat(total[:-1] - v.out_off[ids], size)].tobytes()
    ends = total[bounds]
    return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, decoded: bool = False, check: bool = False) -> DataFrame:
    """id, kept columns and ``ids`` (array of int) per row, as the model's own library encodes the text.

    With ``decoded`` the ids are decoded at once, into ``decoded``; with
    ``check``, ``round_trip`` says whether that gives the text back. The driver
    reads the model; tasks get its tables. Null and empty texts have no ids.
    U+2581 in a text counts as a space. Repeated rows are encoded alike;
    columns not named are dropped.
    """
    v = vocabulary(model_path)
    names = [id_col, *(keep or [])]
    fields = [docs.schema[x] for x in names]
    more = [*(["decoded string"] if decoded else []), *(["round_trip boolean"] if check else [])]

    def run(batches):
        pairs = _Pairs(v)
        for rows, data, off in slices(batches, "_text", SLICE):
            ids, bounds = _encode_slice(v, pairs, data, off)
            columns = [*(rows.column(rows.schema.get_field_index(x)) for x in names), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))]
            if decoded or check:
                back = pa.array(_decode_slice(v, ids.astype(np.int64), bounds), pa.string())
                same = pc.equal(back, pc.fill_null(rows.column(rows.schema.get_field_index("_text")).cast(pa.string()), "")) if check else None
                columns += ([back] if decoded else []) + ([same] if check else [])
            yield pa.RecordBatch.from_arrays(columns, [*names, "ids", *(x.split()[0] for x in more)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids array<int>", *more])
    return docs.select(*names, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """id, kept columns and ``text`` of rows with ``ids``; null ids give an empty text, ids outside the model nothing.

    Bytes that are no UTF-8 (only in ids that no text encodes to) become U+FFFD.
    """
    v = vocabulary(model_path)
    names = [id_col, *(keep or [])]
    fields = [encoded.schema[x] for x in names]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                lists = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else np.zeros(0, np.int64) for x in b.column(b.schema.get_field_index("ids"))]
                lists = [x[(x >= 0) & (x < v.size)] for x in lists]
                texts = _decode_slice(v, np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])]))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in names), pa.array(texts, pa.string())], [*names, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string"])
    return encoded.select(*names, "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``n_byte_tokens``, ``ids_sha256`` and ``decoded_sha256`` of :func:`encode` and :func:`decode`, and whether the text came back.

    ``ids_sha256``: ids in decimal, joined by commas. A null text counts as empty.
    """
    low, high = int(vocabulary(model_path).byte_ids.min()), int(vocabulary(model_path).byte_ids.max())
    encoded = encode(docs, model_path, id_col, text_col, decoded=True, check=True)
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.size(F.filter("ids", lambda i: i.between(low, high))).cast("long").alias("n_byte_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "round_trip",
    )
