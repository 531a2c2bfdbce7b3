"""Helpers shared by the corpus operators: Arrow string columns as byte arrays,
words as vectors of 64-bit hashes, and a few counts per document.

Everything here works on one Arrow batch inside a Spark task. A batch is cut
into slices of about ``SLICE_BYTES`` of text, so that memory does not follow
the number of rows in a batch; a longer document is a slice of its own.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U = np.uint64
#: Spans of up to so many bytes are hashed eight bytes at a time, all at once; longer ones by a digest each.
_SHORT = 64

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of anything but ASCII white space.
PLAIN_WORD = ~SPACES
#: Words are runs of ASCII letters and digits and of all non-ASCII characters.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets of each (nulls are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """(slice of a batch, its text bytes, offsets), each of about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray):
    """Start, end and document of each word; words never reach over documents."""
    m = kind[data]
    n = len(m)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] |= m[cut]
    last[cut - 1] |= m[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


class Eights(NamedTuple):
    """Text bytes, and from each place the next eight bytes as one number (zeros after the end)."""

    data: np.ndarray
    eight: np.ndarray


def eights(data: np.ndarray, lower: bool) -> Eights:
    """``data`` (ASCII letters lower-cased, if asked), readable eight bytes at a time."""
    data = _LOWER[data] if lower else data
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    two = padded[:-1].astype(np.uint16) | (padded[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return Eights(data, four[:-4].astype(U) | (four[4:].astype(U) << U(32)))


def spans_hash(text: Eights, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of substrings [start, end).

    Two lanes take eight bytes a step, and no step is linear, so texts can't be
    arranged to cancel out; long substrings get a cryptographic digest.
    """
    size = end - start
    a = size.astype(U) * U(0xA0761D6478BD642F) + U(0x2545F4914F6CDD1D)
    b = a ^ U(0x94D049BB133111EB)
    long_ = np.flatnonzero(size > _SHORT)
    some = slice(None) if not len(long_) and len(size) and size.min() >= 8 else np.flatnonzero((size > 0) & (size <= _SHORT))
    k = 0
    while len(left := size[some] - k):
        word = text.eight[start[some] + k] & _TAIL[np.minimum(left, 8)]
        x, y = (a[some] ^ word) * U(0xE7037ED1A0B428DB), (b[some] + word) * U(0x8EBC6AF09C88C6E3)
        a[some], b[some] = x ^ (x >> U(32)), y ^ (y >> U(29))
        k += 8
        if left.min() <= 8:
            some = (np.arange(len(size)) if isinstance(some, slice) else some)[left > 8]
    out = mix(a ^ (b << U(23)) ^ (b >> U(41)))
    for i in long_.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(text.data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams_hash(text: Eights, size: int, some: int = 1 << 14) -> np.ndarray:
    """``spans_hash`` of all strings of ``size`` bytes (a multiple of eight, at most 64), ``some`` at a time, as that many stay in a processor's cache."""
    a0 = np.full(1, size, U) * U(0xA0761D6478BD642F) + U(0x2545F4914F6CDD1D)
    out = np.empty(max(len(text.data) - size + 1, 0), U)
    for at in range(0, len(out), some):
        to = min(at + some, len(out))
        a, b = a0, a0 ^ U(0x94D049BB133111EB)
        for k in range(0, size, 8):
            word = text.eight[at + k : to + k]
            a, b = (a ^ word) * U(0xE7037ED1A0B428DB), (b + word) * U(0x8EBC6AF09C88C6E3)
            a, b = a ^ (a >> U(32)), b ^ (b >> U(29))
        out[at:to] = mix(a ^ (b << U(23)) ^ (b >> U(41)))
    return out


def same_bytes(text: Eights, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``start`` and from ``other`` agree, for each."""
    out = np.ones(len(size), bool)
    some, k = np.flatnonzero((size > 0) & (start != other)), 0
    while len(some):
        mask = _TAIL[np.minimum(size[some] - k, 8)]
        equal = (text.eight[start[some] + k] & mask) == (text.eight[other[some] + k] & mask)
        out[some[~equal]] = False
        k += 8
        some = some[equal & (size[some] > k)]
    return out


def fixed_hash(word: str) -> int:
    """The hash that ``spans_hash`` gives a lower-cased word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(spans_hash(eights(b, True), np.array([0]), np.array([len(b)]))[0])


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a document, and where they start."""
    g = rolled(h, n)
    at = np.flatnonzero(doc[: len(g)] == doc[len(h) - len(g) :])
    return mix(g[at]), at


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Numbers (to be mixed) of all n consecutive words, whatever documents they are of."""
    g = np.zeros(max(len(h) - n + 1, 0), U)
    for j in range(n if len(g) else 0):
        g = g * U(0xE7037ED1A0B428DB) + h[j : j + len(g)]
    return g


def shingled(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, in one array, and where each set begins."""
    n = len(off) - 1
    start, end, doc = words(data, off, PLAIN_WORD)
    h = spans_hash(eights(data, True), start, end)
    g, at = windows(h, doc, size)
    first = np.searchsorted(doc, np.arange(n + 1))
    begin = np.searchsorted(doc[at], np.arange(n + 1))
    out = []
    for i in range(n):
        if first[i] == first[i + 1]:
            out.append(np.zeros(0, U))
        elif first[i + 1] - first[i] < size:
            x = U(0x1234567)
            few = np.array([x], U)
            for w in h[first[i] : first[i + 1]]:
                few = mix(few * U(0x9E3779B97F4A7C15) + w)
            out.append(few)
        else:
            out.append(np.unique(g[begin[i] : begin[i + 1]]))
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
    return (np.concatenate(out) if out else np.zeros(0, U)), bounds


def by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of those are not the first."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        same[1:] = k[1:] == k[:-1]
    any_, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    any_[order] = both
    return any_, later


SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_exclaim", "n_stops", "n_distinct", "n_wide", "n_same", "n_chars")


def doc_stats(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts per document, int64, columns as in STATS.

    Words are runs of anything but ASCII white space. n_dup_lines: lines with a
    word that equal an earlier line. n_repeat_words: words in 5-word windows
    found twice or more in the document. n_same: words equal to the one before.
    """
    n = len(off) - 1
    out = np.zeros((n, len(STATS)), np.int64)
    hist = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(off[:-1], off[1:], strict=True)]) if n else np.zeros((0, 256), np.int64)
    chars = hist[:, :0x80].sum(1) + hist[:, 0xC0:].sum(1)
    start, end, doc = words(data, off, PLAIN_WORD)
    text = eights(data, False)
    h = spans_hash(text, start, end)
    salt = mix(np.arange(n, dtype=U) + U(0x51ED))
    count = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    _, later = repeated(h ^ salt[doc])
    g, at = windows(h, doc, 5)
    again, _ = repeated(g ^ salt[doc[at]])
    edge = np.zeros(len(h) + 6, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + 5, -1)
    covered = np.cumsum(edge)[: len(h)] > 0
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([off[:-1], breaks + 1]))
    line_doc = np.searchsorted(off, line_start, "right") - 1
    inside = line_start < off[np.minimum(line_doc, n - 1) + 1] if n else np.zeros(0, bool)
    line_start, line_doc = line_start[inside], line_doc[inside]
    stop = np.minimum(off[line_doc + 1], np.append(breaks, len(data))[np.searchsorted(breaks, line_start)])
    full = np.searchsorted(start, stop) > np.searchsorted(end, line_start, "right")
    line_start, line_doc, stop = line_start[full], line_doc[full], stop[full]
    _, dup = repeated(spans_hash(text, line_start, stop) ^ salt[line_doc])
    out[:, 0] = count
    out[:, 1] = chars - hist[:, SPACES].sum(1)
    out[:, 2] = hist[:, SYMBOLS].sum(1)
    out[:, 3] = by_doc(dup, line_doc, n)
    out[:, 4] = by_doc(covered, doc, n)
    out[:, 5] = np.bincount(line_doc, minlength=n) if len(line_doc) else 0
    out[:, 6] = hist[:, 0x41:0x5B].sum(1)
    out[:, 7] = out[:, 6] + hist[:, 0x61:0x7B].sum(1)
    out[:, 8] = hist[:, 0x30:0x3A].sum(1)
    out[:, 9] = hist[:, 0x21]
    out[:, 10] = hist[:, [0x2C, 0x2E, 0x3A, 0x3B, 0x3F]].sum(1)
    out[:, 11] = count - by_doc(later, doc, n)
    out[:, 12] = hist[:, 0xC0:].sum(1)
    out[:, 13] = by_doc(same, doc, n)
    out[:, 14] = chars
    return out
