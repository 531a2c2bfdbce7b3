"""Near-duplicate documents: MinHash signatures joined by Hamming distance, links confirmed on full sets.

A signature is ``SYMBOLS`` minima of random orders over a document's shingles,
``16`` bits of each. It is cut into ``CHUNKS`` chunks, and each chunk gives one
key for every choice of ``ERRORS`` symbols left out. By the pigeonhole
principle, two signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1``
symbols share a key; so all such pairs are found. (Pairs at the similarity
threshold of 0.8 that differ in more are still found if any one chunk is close;
the chance that none is, is about 2e-5.)

Pairs that share a key are not written out. Equal sets are one node. In each
key's group every member is linked to the first, if confirmed; in groups that
then hold several components, members of others to one drawn by hash. Where
several are still left, pairs across components are compared; members of
crowded groups, of any size, go down prefix trees of their sets instead
(``ngram_join``), so that no pair of theirs is written. This loses no link
that matters for the components, and a group never meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.graph import components
from skyloom.llm.ngram_join import by_prefix, links_across
from skyloom.llm.scratch import written
from skyloom.llm.textops import U, mix, shingled, slices

CHUNKS, WIDTH, ERRORS = 8, 5, 1
SYMBOLS = CHUNKS * WIDTH
PACKED = [f"s{i}" for i in range(SYMBOLS // 4)]
#: Up to so many ids are sent to every task; beyond, the join shuffles.
FEW_IDS = 500_000
#: Members of a group that are compared two by two; larger groups are crowded.
BLOCK = 512
_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def signatures(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_shingles``, ``h1, h2`` (128-bit hash of the set), and the signature, four symbols in each of PACKED.

    An empty set has a hash of its own for each row, and so equals no other.
    """
    field = docs.schema[id_col]

    def run(batches):
        for rows, data, off in slices(batches, "_text"):
            values, bounds = shingled(data, off, shingle)
            size = np.diff(bounds)
            has = np.flatnonzero(size)
            begin = bounds[:-1][has]
            sig = np.zeros((rows.num_rows, SYMBOLS), U)
            h = np.random.default_rng().integers(0, 1 << 63, (2, rows.num_rows), dtype=np.uint64)
            if len(has):
                for k in range(SYMBOLS):
                    sig[has, k] = mix(np.minimum.reduceat(values * _MUL[k] + _ADD[k], begin)) & U(0xFFFF)
                h[0, has], h[1, has] = mix(np.add.reduceat(mix(values), begin)), mix(np.add.reduceat(mix(values ^ U(0xABCDEF)), begin))
            packed = [sig[:, 4 * i] | (sig[:, 4 * i + 1] << U(16)) | (sig[:, 4 * i + 2] << U(32)) | (sig[:, 4 * i + 3] << U(48)) for i in range(len(PACKED))]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), *(pa.array(x.view(np.int64)) for x in (h[0], h[1], *packed))], [id_col, "n_shingles", "h1", "h2", *PACKED])

    schema = f"`{id_col}` {field.dataType.simpleString()}, n_shingles long, h1 long, h2 long, {', '.join(f'{x} long' for x in PACKED)}"
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def key_rows(nodes: DataFrame) -> DataFrame:
    """(node, slot, key) for each chunk of a signature and each symbol left out of it; slots count these from 0."""

    def run(batches):
        for b in batches:
            sig = np.stack([b.column(i + 1).to_numpy().view(U) for i in range(len(PACKED))], axis=1)
            sym = np.stack([(sig[:, k // 4] >> U(16 * (k % 4))) & U(0xFFFF) for k in range(SYMBOLS)], axis=1)
            keys = []
            for c in range(CHUNKS):
                for out in range(WIDTH):
                    x = np.full(b.num_rows, U(c * WIDTH + out + 1))
                    for j in range(WIDTH):
                        if j != out:
                            x = mix(x * U(0x9E3779B97F4A7C15) + sym[:, c * WIDTH + j])
                    keys.append(x)
            flat = np.stack(keys, axis=1).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(keys), dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["node", "keys"])

    return nodes.select("node", *PACKED).mapInArrow(run, "node long, keys array<long>").select("node", F.posexplode("keys").alias("slot", "key"))


def shingle_sets(docs: DataFrame, ids: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, set) of the documents in ``ids`` (node): the hashes of its shingles."""
    few = ids.count() <= FEW_IDS
    mine = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("_text")).join(F.broadcast(ids) if few else ids, "node", "left_semi")

    def run(batches):
        for rows, data, off in slices(batches, "_text"):
            values, bounds = shingled(data, off, shingle)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))], ["node", "set"])

    return mine.mapInArrow(run, "node long, set array<long>")


def _symbols(packed: np.ndarray) -> np.ndarray:
    """[rows, SYMBOLS] of [rows, PACKED]."""
    return np.ascontiguousarray(packed.astype("<i8")).view("<u2")


def near_members(groups: DataFrame, percent: int) -> DataFrame:
    """(key, node, component): members of groups (key, slot, members) with a partner in another component.

    A partner's size allows the similarity, and the group's key is the first
    that the two share, so that a pair counts in one group only.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, slots = (batch.column(i).to_numpy() for i in range(2))
            off, fields = batch.column(2).offsets.to_numpy(), batch.column(2).values.flatten()
            node, comp, size = (x.to_numpy() for x in fields[:3])
            sig = _symbols(np.stack([x.to_numpy() for x in fields[3:]], axis=1))
            found = []
            for r in range(batch.num_rows):
                end = off[r + 1]
                near = np.zeros(end - off[r], bool)
                for at in range(off[r], end, 128):
                    some, rest = slice(at, min(at + 128, end)), slice(at, end)
                    small, large = np.minimum(size[some, None], size[rest]), np.maximum(size[some, None], size[rest])
                    i, j = np.nonzero((comp[some, None] != comp[rest]) & (100 * small >= percent * large))
                    for k in range(0, len(i), 1 << 16):
                        x, y = at + i[k : k + (1 << 16)], at + j[k : k + (1 << 16)]
                        differ = (sig[x] != sig[y]).reshape(-1, CHUNKS, WIDTH)
                        first = (differ.sum(2) <= ERRORS).argmax(1)
                        spot = differ[np.arange(len(x)), first].argmax(1)
                        own = first * WIDTH + spot == slots[r]
                        near[x[own] - off[r]] = near[y[own] - off[r]] = True
                found.append(off[r] + np.flatnonzero(near))
            group = np.repeat(keys, [len(x) for x in found])
            at = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(node[at], pa.int64()), pa.array(comp[at], pa.int64())], ["key", "node", "component"])

    return groups.select("key", "slot", "members").mapInArrow(run, "key long, node long, component long")


def similar_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components within each group (column members: node, component, set), by exact intersections.

    Shingles that two or more members have are columns of a 0/1 matrix, a few
    thousand at a time; its product with itself counts all intersections.
    """

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            off = column.offsets.to_numpy()
            fields = column.values.flatten()
            node, comp = fields[0].to_numpy(), fields[1].to_numpy()
            set_off, shingles = fields[2].offsets.to_numpy(), fields[2].values.to_numpy()
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in range(batch.num_rows):
                a, b = off[r], off[r + 1]
                size = np.diff(set_off[a : b + 1]).astype(np.int64)
                values, member = shingles[set_off[a] : set_off[b]], np.repeat(np.arange(b - a), size)
                order = np.argsort(values, kind="stable")
                values, member = values[order], member[order]
                same = np.zeros(len(values) + 1, bool)
                same[1:-1] = values[1:] == values[:-1]
                twice = same[1:] | same[:-1]
                values, member = values[twice], member[twice]
                column_of = np.cumsum(np.diff(values, prepend=values[:1]) != 0) if len(values) else values
                shared = np.zeros((b - a, b - a), np.float32)
                last = int(column_of[-1]) + 1 if len(column_of) else 0
                for k in range(0, last, 4096):
                    x, y = np.searchsorted(column_of, (k, k + 4096))
                    grid = np.zeros((b - a, min(4096, last - k)), np.float32)
                    grid[member[x:y], column_of[x:y] - k] = 1
                    shared += grid @ grid.T
                linked = 100 * shared.astype(np.int64) >= percent * (size[:, None] + size - shared.astype(np.int64))
                i, j = np.nonzero(linked & (comp[a:b][:, None] != comp[a:b]) & (node[a:b][:, None] < node[a:b]))
                out_a.append(node[a:b][i])
                out_b.append(node[a:b][j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return groups.select("members").mapInArrow(run, "a long, b long").distinct()


def among_crowded(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of ``crowded`` (node, component) as far as any links between its nodes do."""
    links = crowded.select(F.col("component").alias("a"), F.col("node").alias("b")).filter("a <> b")
    if crowded.isEmpty():
        return links
    own = written(sets.join(crowded.select("node"), "node", "left_semi").select("node", F.size("set").cast("long").alias("n"), F.col("set").alias("grams")), "grams")
    return links_across(*by_prefix(own, percent), links, percent)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(two, "b").join(one, "a").filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_shingles``, ``component_id``, ``kept``, one row for each row of ``docs``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their sets of distinct word shingles (ASCII letters lower-cased, words as
    runs of anything but ASCII white space; shorter texts are one shingle).
    ``component_id`` is the smallest id reachable over links; ``kept`` is true
    for the document of that id. Null, empty and blank texts have no shingle
    and are linked with nothing. Rows that share an id count as one node; null
    ids are never linked. Other columns are not read.
    """
    sigs = written(signatures(docs.withColumn(id_col, F.col(id_col).cast("long")), shingle, id_col, text_col), "signatures")
    nodes = sigs.filter(f"n_shingles > 0 and `{id_col}` is not null").groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min(id_col).alias("node"), *(F.first(s).alias(s) for s in PACKED))
    nodes = written(nodes, "nodes")
    groups = key_rows(nodes).groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low")).filter("size > 1")
    groups = written(groups, "groups")
    members = written(key_rows(nodes).join(groups, "key"), "members")
    ids = written(members.select("node").distinct(), "ids")
    sets = written(shingle_sets(docs, ids, shingle, id_col, text_col), "sets")
    signed = written(nodes.join(ids, "node", "left_semi").select("node", "n", *PACKED), "signed")
    size = lambda node, n: signed.select(F.col("node").alias(node), F.col("n").alias(n))

    def linked(pairs: DataFrame) -> DataFrame:
        sized = pairs.distinct().join(size("b", "n_b"), "b").join(size("a", "n_a"), "a")
        close = sized.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        return written(confirmed(close.select("a", "b"), sets, percent), "links")

    def across_components(labels: DataFrame) -> DataFrame:
        placed = written(members.join(labels, "node", "left").select("key", "slot", "node", F.coalesce("component", "node").alias("component"), "size"), "placed")
        mixed = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min(F.struct(F.xxhash64("node", "key").alias("draw"), "node", "component")).alias("rep")).filter("c1 < c2")
        return written(placed.join(mixed.select("key", F.col("rep.node").alias("rep"), F.col("rep.component").alias("rep_component")), "key"), "open")

    links = linked(members.select(F.col("low").alias("a"), F.col("node").alias("b")).filter("a <> b"))
    open_ = across_components(components(links))
    links = links.union(linked(open_.filter("component <> rep_component").select(F.least("rep", "node").alias("a"), F.greatest("rep", "node").alias("b"))))
    labels = components(links)
    open_ = across_components(labels).select("key", "slot", "node", "component", "size")
    crowded = open_.filter(F.col("size") > BLOCK).select("node", "component").distinct()
    more = among_crowded(written(crowded, "crowded"), sets, percent)
    members = open_.filter(F.col("size") <= BLOCK).join(signed, "node").groupBy("key", F.col("slot").cast("long").alias("slot")).agg(F.collect_list(F.struct("node", "component", "n", *PACKED)).alias("members"))
    close = written(near_members(members, percent), "close")
    groups = close.join(sets, "node").groupBy("key").agg(F.collect_list(F.struct("node", "component", "set")).alias("members"))
    more = written(similar_pairs(groups, percent).union(more), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    found = written(nodes.join(labels, "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component_id")), "found")
    out = sigs.select(id_col, "n_shingles", "h1", "h2").join(found.withColumnRenamed("n", "n_shingles"), ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col(id_col).isNotNull(), F.coalesce("component_id", id_col))
    return out.select(id_col, "n_shingles", component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))


COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), e AS (
  SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS kept
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
