"""Bytes of documents that belong to a string found elsewhere, by suffix sorting.

Every window of ``LENGTH`` bytes has an anchor: the smallest hash among its
``GRAM``-byte strings, the leftmost on ties. Equal windows have equal anchors
at equal places, so windows can only be equal within the group of an anchor's
hash. The windows that share one anchor form a segment of a document.

1. Equal texts are one, and equal segments are one; both are repeated as a whole.
2. In groups with different segments, a task sorts the suffixes that begin at
   windows: directly those smaller than their successor, the others by
   scanning buckets; windows next to each other with a common prefix of
   ``LENGTH`` bytes are repeated.
3. A group of more than ``CROWD`` segments is cut by distance from the anchor
   into halves, which are grouped anew by the bytes that all windows of a half
   share; halves that are equal are one again, so groups shrink as their halves
   come closer to the anchor. Halving ends at single windows, which are equal if
   those bytes are. So no group meets in one task, however many documents share
   a passage.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.scratch import written
from skyloom.llm.textops import PLAIN_WORD, U, eights, grams_hash, mix, rolled, slices, spans_hash, windows, words

LENGTH = 400
GRAM = 32
#: Passages are of so many words or more; their anchors are strings of FEW_WORDS words.
WORDS = 50
FEW_WORDS = 16
CROWD = 100
#: Up to so many row keys are sent to every task; beyond, the join shuffles.
FEW_IDS = 500_000
#: Bytes of segments sorted at a time, unless one group has more.
SORT_BYTES = 1 << 19
_PIECE = 1 << 23
_LOW = U((1 << 24) - 1)


def _anchors(hashes: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Anchor place, first and last window of each segment, over all documents of a slice (at most 2**24 symbols); ``hashes`` are of all strings of ``gram`` symbols."""
    n = len(hashes)
    w = length - gram + 1
    if n < w:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    key = (hashes & ~_LOW) | np.arange(n).astype(U)
    padded = np.full(-(-n // w) * w, ~U(0))
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    least = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & _LOW).astype(np.int64)
    inside = np.zeros(n + gram, np.int32)
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a >= length:
            inside[a] += 1
            inside[b - length + 1] -= 1
    valid = np.cumsum(inside[:m]) > 0
    start = valid.copy()
    start[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    cut = off[1:-1]
    cut = cut[cut < m]
    start[cut] |= valid[cut]
    lo = np.flatnonzero(start)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | start[1:]
    return least[lo], lo, np.flatnonzero(stop)


def _pieces(n: int, off: np.ndarray, length: int):
    """(first and last symbol, bounds of documents) of what is worked on at a time: a whole slice, or parts of one long document."""
    if n <= _PIECE * 2:
        return [(0, n, off)]
    ends = [(a, min(a + _PIECE + length - 1, n)) for a in range(0, n, _PIECE)]
    return [(a, b, np.array([0, b - a])) for a, b in ends]


def _joined(out: list, kinds: tuple):
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, k) for k in kinds)


def _segments(data: np.ndarray, off: np.ndarray, length: int):
    """(document, anchor hash, segment hash, first and last window, anchor place), places within the document."""
    out = []
    for a, b, bounds in _pieces(len(data), off, length):
        view = eights(data[a:b], False)
        hashes = grams_hash(view, GRAM)
        place, lo, hi = _anchors(hashes, bounds, length, GRAM)
        doc = np.searchsorted(bounds, lo, "right") - 1
        base = bounds[doc] - a
        out.append((doc, hashes[place], spans_hash(view, lo, hi + length), lo - base, hi - base, place - base))
    return _joined(out, (np.int64, U, U, np.int64, np.int64, np.int64))


def _word_segments(data: np.ndarray, off: np.ndarray):
    """(document, anchor hash, segment hash, first and last byte) of segments of windows of WORDS words; bytes within the document, end exclusive."""
    start, end, word_doc = words(data, off, PLAIN_WORD)
    h = spans_hash(eights(data, False), start, end)
    first = np.searchsorted(word_doc, np.arange(len(off)))
    out = []
    for a, b, bounds in _pieces(len(h), first, WORDS):
        hashes, whole = mix(rolled(h[a:b], FEW_WORDS)), mix(rolled(h[a:b], WORDS))
        place, lo, hi = _anchors(hashes, bounds, WORDS, FEW_WORDS)
        doc = word_doc[lo + a]
        segment = mix(whole[lo] ^ mix(whole[hi] + (hi - lo).astype(U)))
        out.append((doc, hashes[place], segment, start[lo + a] - off[doc], end[hi + a + WORDS - 1] - off[doc]))
    return _joined(out, (np.int64, U, U, np.int64, np.int64))


PLACE = "struct<anchor:long,segment:long,lo:int,hi:int,place:int>"
WORD_PLACE = "struct<anchor:long,segment:long,start:long,stop:long>"
RUNS = "array<struct<start:long,stop:long>>"


def marks(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """id, ``row_key``, ``n_bytes``, ``h1, h2`` (hash of the text), ``sha``, ``segments`` and ``word_segments`` of each row."""
    field = docs.schema[id_col]

    def run(batches):
        for rows, data, off in slices(batches, "_text", 1 << 20):
            n = rows.num_rows
            doc, anchor, segment, lo, hi, place = _segments(data, off, length)
            view = eights(data, False)
            h1 = spans_hash(view, off[:-1], off[1:])
            raw = data.tobytes()
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(off[:-1], off[1:], strict=True)]
            h2 = np.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], np.int64)
            kinds = (anchor.view(np.int64), segment.view(np.int64), lo.astype(np.int32), hi.astype(np.int32), place.astype(np.int32))
            items = pa.StructArray.from_arrays([pa.array(x) for x in kinds], ["anchor", "segment", "lo", "hi", "place"])
            bounds = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            doc, *kinds = _word_segments(data, off)
            word_items = pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in kinds], ["anchor", "segment", "start", "stop"])
            word_bounds = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            ids = rows.column(0)
            keys = ids.cast(pa.int64()).to_numpy(zero_copy_only=False)
            keys = np.where(np.isnan(keys.astype(float)), h2, np.nan_to_num(keys.astype(float)).astype(np.int64)) if ids.null_count else keys
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys.astype(np.int64)), pa.array(np.diff(off)), pa.array(h1.view(np.int64)), pa.array(h2), pa.array([d.hex() for d in digests]), pa.ListArray.from_arrays(pa.array(bounds), items), pa.ListArray.from_arrays(pa.array(word_bounds), word_items)], [id_col, "row_key", "n_bytes", "h1", "h2", "sha", "segments", "word_segments"])

    schema = f"`{id_col}` {field.dataType.simpleString()}, row_key long, n_bytes long, h1 long, h2 long, sha string, segments array<{PLACE}>, word_segments array<{WORD_PLACE}>"
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def two_stage_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places in ``wanted`` (a mask), in the order of their suffixes' first ``depth`` bytes.

    A suffix larger than its successor is not compared: it follows from the
    successor's place, by one scan over the buckets of first bytes. ``text``
    must end with a byte larger than all others.
    """
    n = len(text)
    turns = np.flatnonzero(text[1:] != text[:-1])
    nxt = turns[np.minimum(np.searchsorted(turns, np.arange(n)), len(turns) - 1)] if len(turns) else np.zeros(n, np.int64)
    larger = text[nxt] > text[np.minimum(nxt + 1, n - 1)]
    need = wanted.copy()
    fresh = np.flatnonzero(wanted & larger) + 1
    while len(fresh):
        fresh = fresh[~need[fresh]]
        need[fresh] = True
        fresh = fresh[larger[fresh]] + 1
    raw = text.tobytes()
    direct = np.array(sorted(np.flatnonzero(need & ~larger).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced = need & larger
    out = []
    for c in range(256):
        scan = waiting[c]
        last = np.concatenate(scan) if scan else direct[:0]
        rounds = [last]
        while len(last):
            last = last[last > 0] - 1
            last = last[induced[last] & (text[last] == c)]
            rounds.append(last)
        bucket = np.concatenate([*rounds, direct[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            for x in np.unique(first):
                waiting[x].append(before[np.searchsorted(first, x) : np.searchsorted(first, x, "right")])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix, at most ``length``, of each adjacent pair in ``order``; compared eight bytes at a time, as far as they agree."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    out = np.full(max(len(order) - 1, 0), length, np.int32)
    x, y, open_ = order[:-1], order[1:], np.arange(len(out))
    for k in range(0, length, 8):
        differ = eight[x + k] ^ eight[y + k]
        end = differ != 0
        lowest = differ[end] & (~differ[end] + U(1))
        out[open_[end]] = k + np.log2(lowest.astype(float)).astype(np.int32) // 8
        x, y, open_ = x[~end], y[~end], open_[~end]
        if not len(x):
            break
    return np.minimum(out, length)


def _whole_groups(batches, limit: int):
    """Tables of whole groups (equal ``key``, rows sorted by it) of about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        bytes_ = np.cumsum(pc.binary_length(b.column(b.schema.get_field_index("bytes"))).to_numpy())
        at = 0
        if held and held[-1].column(0)[-1].as_py() != keys[0] and size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        for e in ends[:-1]:
            size_here = size + int(bytes_[e - 1] - (bytes_[at - 1] if at else 0))
            if size_here >= limit:
                yield pa.Table.from_batches([*held, b.slice(at, e - at)])
                held, size, at = [], 0, e
        if at < len(keys):
            held.append(b.slice(at))
            size += int(bytes_[-1] - (bytes_[at - 1] if at else 0))
    if held:
        yield pa.Table.from_batches(held)


SPAN = "row_key long, start long, stop long"
PIECES = "key long, row_key long, base long, alone boolean, first int, last int, place int, d0 int, d1 int, bytes binary"


def repeated_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of bytes under repeated windows, of pieces (see PIECES) whose groups are of a bounded size."""

    def run(batches):
        for t in _whole_groups(batches, SORT_BYTES):
            col = {x: t.column(x).to_numpy() for x in ("row_key", "base", "first", "last", "alone")}
            data = t.column("bytes").to_pylist()
            size = np.array([len(x) for x in data])
            begin = np.concatenate([[0], np.cumsum(size)])
            text = np.frombuffer(b"".join([*data, b"\xff"]), np.uint8)
            edge = np.zeros(len(text) + 1, np.int32)
            edge[begin[:-1] + col["first"]] += 1
            edge[begin[:-1] + col["last"] + 1] -= 1
            wanted = np.cumsum(edge)[: len(text)] > 0
            order = two_stage_order(text, wanted, length)
            same = common_prefixes(text, order, length) == length
            hit = np.zeros(len(text) + 1, bool)
            hit[order[:-1][same]] = True
            hit[order[1:][same]] = True
            hit[:-1] &= wanted
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            piece = np.searchsorted(begin, at, "right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])
            i = np.flatnonzero(new)
            j = np.append(i[1:], len(at)) - 1
            p = piece[i]
            mine = col["alone"][p]
            i, j, p = i[mine], j[mine], p[mine]
            shift = col["base"][p] - begin[p]
            yield pa.RecordBatch.from_arrays([pa.array(col["row_key"][p]), pa.array(at[i] + shift), pa.array(at[j] + shift + length)], ["row_key", "start", "stop"])

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPAN)


def halves(pieces: DataFrame, length: int) -> DataFrame:
    """Each piece cut at the middle of its band of distances from the anchor, with keys by what all windows of the band share.

    ``twin`` is a hash of a half's windows: halves of one key and twin are equal.
    """

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            out: dict[str, list] = {x: [] for x in b.schema.names}
            spots: list[int] = []
            text = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
            view = eights(text, False)
            at = 0
            starts, stops, tags = [], [], []
            for r in rows:
                mid = (r["d0"] + r["d1"]) // 2
                for d0, d1 in ((r["d0"], mid), (mid, r["d1"])):
                    first, last = max(r["first"], r["place"] - d1 + 1), min(r["last"], r["place"] - d0)
                    if first > last or d0 == d1:
                        continue
                    half = {"base": r["base"] + first, "first": 0, "last": last - first, "place": r["place"] - first, "d0": d0, "d1": d1, "bytes": r["bytes"][first : last + length]}
                    for k, v in (r | half).items():
                        out[k].append(v)
                    spots.append(at + first)
                    starts.append(at + r["place"] - d0)
                    stops.append(at + r["place"] - d1 + 1 + length)
                    tags.append(r["key"] * 1024 + d0)
                at += len(r["bytes"])
            core = spans_hash(view, np.array(starts, np.int64), np.array(stops, np.int64))
            tag = np.array([t % (1 << 64) for t in tags], U)
            out["key"] = mix(core ^ mix(tag)).view(np.int64)
            spot = np.array(spots, np.int64)
            whole = spans_hash(view, spot, spot + np.array([len(x) for x in out["bytes"]], np.int64))
            twin = mix(whole ^ mix(np.array(out["place"], np.int64).astype(U))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(out[f.name], f.type) for f in b.schema), pa.array(twin)], [*b.schema.names, "twin"])

    return pieces.mapInArrow(run, PIECES + ", twin long")


def _one_of_equals(cut: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(pieces with one for each key and twin, spans of those that have an equal)."""
    rest = [f.split()[0] for f in PIECES.split(", ") if not f.startswith(("key", "alone"))]
    kinds = written(cut.groupBy("key", "twin").agg(F.count("*").alias("n"), F.max("alone").alias("any"), F.min(F.struct(*rest)).alias("x")), "kinds")
    equal = cut.filter("alone").join(kinds.filter("n > 1 and any").select("key", "twin"), ["key", "twin"])
    spans = equal.select("row_key", (F.col("base") + F.col("first")).alias("start"), (F.col("base") + F.col("last") + length).alias("stop"))
    one = kinds.select("key", "x.*", (F.col("any") & (F.col("n") == 1)).alias("alone"))
    return one.select(*(f.split()[0] for f in PIECES.split(", "))), written(spans, "spans")


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` joined with ``rows`` on row_key. If few, the keys alone go to every task first, so that fewer texts are shuffled."""
    if rows.count() <= FEW_IDS:
        docs = docs.join(F.broadcast(rows.select("row_key")), "row_key", "left_semi")
    return docs.join(rows.hint("merge"), "row_key")


def passages(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """``row_key`` and ``passages``: the maximal runs (start, stop, in bytes) of words under windows of WORDS words that another row has too.

    ``rows`` are those of ``marks``, ``keyed`` has their ``row_key`` and bytes
    (``raw``). Words are runs of anything but ASCII white space, and equal as
    bytes; what stands between them is not compared. Equal windows have equal
    anchors, so only segments whose anchor another row has are looked at: those
    that are equal as a whole first, then the others, and two rows' of each kind
    of equal ones, by their windows. Rows of one id, and equal texts without an
    id, are one row here.
    """
    places = rows.select("row_key", F.explode("word_segments").alias("s")).select("row_key", "s.*")
    shared = places.groupBy("anchor").count().filter("count > 1").select("anchor")
    places = written(places.join(shared.hint("shuffle_hash"), "anchor"), "word_places")
    one = F.struct("row_key", "start", "stop")
    kinds = written(places.groupBy("anchor", "segment").agg(F.min(one).alias("x"), F.max(one).alias("y")).withColumn("alone", F.col("x.row_key") == F.col("y.row_key")), "word_kinds")
    dealt = places.join(kinds.hint("shuffle_hash"), ["anchor", "segment"])
    places = written(dealt.select("anchor", "row_key", "start", "stop", "alone", (F.col("alone") | (one == F.col("x")) | (one == F.col("y"))).alias("open")), "word_places")
    crowds = kinds.groupBy("anchor").agg(F.count("*").alias("size"), F.max("alone").alias("any")).filter("size > 1 and any").select("anchor")
    open_ = places.filter("open").join(crowds.hint("shuffle_hash"), "anchor")
    cuts = written(open_.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("cuts")), "word_cuts")
    same = Window.partitionBy("window")
    at = _windows(_only(keyed, cuts).dropDuplicates(["row_key"])).select("*", F.min("row_key").over(same).alias("first"), F.max("row_key").over(same).alias("last"))
    spans = places.filter("not alone").select("row_key", "start", "stop").union(at.filter("first < last").select("row_key", "start", "stop"))
    runs = spans.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs"))
    return written(runs.mapInArrow(_maximal, f"row_key long, passages {RUNS}"), "passages")


def _merged(runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of lists of sorted (start, stop): the list each is of, and where it begins and ends."""
    row = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
    far = row << 40
    start, stop = (runs.flatten().field(i).to_numpy() + far for i in (0, 1))
    stop = np.maximum.accumulate(stop)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)[: new.sum()]
    return row[new], start[new] - far[new], stop[last] - far[last]


def _maximal(batches):
    for b in batches:
        row, start, stop = _merged(b.column(1))
        items = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "stop"])
        bounds = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bounds), items)], ["row_key", "passages"])


def _windows(rows: DataFrame) -> DataFrame:
    """The windows of WORDS words in each row's ``cuts``."""

    def run(batches):
        for b in batches:
            raw = b.column(1).cast(pa.large_binary())
            whole = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            row, start, stop = _merged(b.column(2))
            off = np.concatenate([[0], np.cumsum(stop - start)])
            shift = start - off[:-1]
            text = np.frombuffer(raw.buffers()[2], np.uint8)[np.arange(off[-1]) + np.repeat(whole[row] + shift, stop - start)]
            first, last, part = words(text, off, PLAIN_WORD)
            window, at = windows(spans_hash(eights(text, False), first, last), part, WORDS)
            part = part[at]
            keys = b.column(0).to_numpy()[row[part]]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(window.view(np.int64)), pa.array(first[at] + shift[part]), pa.array(last[at + WORDS - 1] + shift[part])], ["row_key", "window", "start", "stop"])

    return rows.select("row_key", "raw", "cuts").mapInArrow(run, "row_key long, window long, start long, stop long")


def repeated_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept_text``, ``removed``, ``passages`` per row of ``docs``.

    Removed is each byte under a string of ``length`` bytes that also starts
    anywhere else, in the same or another document; strings may overlap, never
    cross documents, and are judged on the input. ``removed`` lists the maximal
    runs (start, stop) in bytes; ``kept_text`` is null unless a part was
    removed and a part stayed (cuts may split a character; such bytes show as
    U+FFFD there, not in the digest). Null texts are empty; empty texts, and
    those below ``length`` bytes, keep all. Rows may repeat: equal texts of
    ``length`` bytes or more are removed as a whole. ``passages`` are runs of
    WORDS words or more that another row has too, also where they are below
    ``length`` bytes and so not removed. Ids must differ between rows of
    different text, or be null; other columns are not read.
    """
    rows = written(marks(docs.withColumn(id_col, F.col(id_col).cast("long")), length, id_col, text_col), "marks")
    texts = written(rows.filter(F.col("n_bytes") >= length).groupBy("h1", "h2").agg(F.min("row_key").alias("row_key"), F.count("*").alias("copies")), "texts")
    nodes = rows.select("row_key", "h1", "h2", "segments").join(texts.select("h1", "h2", "row_key", "copies"), ["row_key", "h1", "h2"]).dropDuplicates(["row_key"])
    places = nodes.select("row_key", F.explode("segments").alias("s")).select("row_key", "s.*")
    kinds = written(places.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "lo", "hi", "place")).alias("x")), "segments")
    whole = places.join(kinds.filter("n > 1").select("segment", "anchor"), ["anchor", "segment"]).select("row_key", F.col("lo").cast("long").alias("start"), (F.col("hi") + length).cast("long").alias("stop"))
    spans = [written(whole, "spans")]
    groups = written(kinds.groupBy("anchor").agg(F.count("*").alias("size")).filter("size > 1"), "groups")
    open_ = written(kinds.join(groups.select("anchor"), "anchor").select(F.col("anchor").alias("key"), (F.col("n") == 1).alias("alone"), "x.*"), "open")
    cuts = written(open_.groupBy("row_key").agg(F.collect_list(F.struct("key", "alone", "lo", "hi", "place")).alias("cuts")), "cuts")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), _text_key(F.col(text_col))).alias("row_key"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("raw"))
    cut = _only(keyed, cuts).select("row_key", F.col("raw"), F.explode("cuts").alias("c"))
    pieces = cut.select(
        F.col("c.key").alias("key"), "row_key", F.col("c.lo").cast("long").alias("base"), F.col("c.alone").alias("alone"),
        F.lit(0).alias("first"), (F.col("c.hi") - F.col("c.lo")).alias("last"), (F.col("c.place") - F.col("c.lo")).alias("place"),
        F.lit(0).alias("d0"), F.lit(length - GRAM + 1).alias("d1"), F.substring(F.col("raw"), F.col("c.lo") + 1, F.col("c.hi") - F.col("c.lo") + length).alias("bytes"),
    )
    once = rows.groupBy("row_key").count().filter("count > 1").isEmpty()
    if not once:
        pieces = pieces.dropDuplicates(["row_key", "base"])
    pieces = written(pieces, "pieces")
    width = length - GRAM + 1
    while True:
        sizes = written(pieces.groupBy("key").agg(F.count("*").alias("size"), F.max("alone").alias("any")).filter("size > 1 and any"), "sizes")
        if sizes.isEmpty():
            break
        calm = pieces.join(sizes.filter(F.col("size") <= CROWD).select("key"), "key", "left_semi")
        spans.append(written(repeated_spans(calm, length), "spans"))
        crowded = sizes.filter(F.col("size") > CROWD).select("key")
        if crowded.isEmpty():
            break
        pieces, equal = _one_of_equals(written(halves(pieces.join(crowded, "key", "left_semi"), length), "pieces"), length)
        spans.append(equal)
        width = (width + 1) // 2
    all_spans = spans[0]
    for s in spans[1:]:
        all_spans = all_spans.union(s)
    runs = (all_spans.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs")))
    repeats = texts.filter("copies > 1").select("row_key")
    partly = written(runs.join(repeats, "row_key", "left_anti"), "partly")
    cut = _only(keyed, partly)
    removed = written(_removed(cut if once else cut.dropDuplicates(["row_key"])), "removed")
    known = rows.drop("segments", "word_segments").join(passages(rows, keyed), "row_key", "left").join(texts.select("h1", "h2", "copies", F.col("row_key").alias("node")), ["h1", "h2"], "left").join(removed.withColumnRenamed("row_key", "node"), "node", "left")
    full = F.coalesce(F.col("copies") > 1, F.lit(False))
    nothing = F.array().cast(RUNS)
    runs_ = F.when(full, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))).otherwise(F.coalesce("removed", nothing))
    return known.select(
        id_col,
        "n_bytes",
        F.aggregate(runs_, F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"]).alias("n_removed"),
        F.size(runs_).cast("long").alias("n_spans"),
        F.when(full, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        "kept_text",
        runs_.alias("removed"),
        F.coalesce("passages", nothing).alias("passages"),
    )


def _text_key(text):
    """The key of a row without an id: eight bytes of its text's SHA-256, little-endian."""
    digest = F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)
    number = lambda a: F.conv(F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in a)), 16, -10).cast("long")
    return number(range(7, -1, -1))


def _removed(rows: DataFrame) -> DataFrame:
    """Merge each row's spans; the digest and text of what is left."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"row_key": b.column(b.schema.get_field_index("row_key")).to_pylist(), "removed": [], "kept_sha256": [], "kept_text": []}
            for raw, runs in zip(b.column(b.schema.get_field_index("raw")), b.column(b.schema.get_field_index("runs")), strict=True):
                raw = raw.as_py()
                start, stop = runs.values.field(0).to_numpy(), np.maximum.accumulate(runs.values.field(1).to_numpy())
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > stop[:-1]
                a, z = start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
                left = b"".join(raw[x:y] for x, y in zip(np.concatenate([[0], z]), np.concatenate([a, [len(raw)]]), strict=True))
                out["removed"].append([{"start": int(x), "stop": int(y)} for x, y in zip(a, z, strict=True)])
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept_text"].append(left.decode("utf-8", "replace"))
            kinds = {"row_key": pa.int64(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "kept_sha256": pa.string(), "kept_text": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    return rows.select("row_key", "raw", "runs").mapInArrow(run, "row_key long, removed array<struct<start:long,stop:long>>, kept_sha256 string, kept_text string")
