"""Jaccard self-join of documents on their sets of word n-grams, by prefix trees.

Sets are ordered globally, n-grams of few documents first. Two similar sets
share one of the first n - ceil(percent n / 100) + 1 of each, so the documents
that hold such an n-gram form a group, and every link lies in some group. A
group's sets become a trie: a path of n-grams that several sets begin with is
stored, and counted, once. A document goes down the trie with the overlap so
far; a subtree is left when what remains of it and of the document can't bring
any of its sets to the threshold.

Most documents can't have a partner, and never get so far: over the order of
hashes, a set that is to share ceil(percent n / 100) of its n-grams shares a
known number of its first ones, so those with fewer n-grams in common with
anyone are left out; the same holds for whole sets afterwards.

Sets are sent once, to the group of the first n-gram in their prefix, and the
links found there join documents to components. Then only groups that hold
several components are of interest: one document of each component is sent to
each such group, twice, and at last all documents of the groups that are still
open; of groups with the same components, or the same documents, one is enough. Groups are cut into packs of bounded size. Links within a component
are not looked for, so pairs of a group are never written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.graph import components
from skyloom.llm.scratch import written
from skyloom.llm.textops import U, mix, shingled, slices

#: Share of a set, in percent, that the filter looks at beyond the prefix of the join.
AHEAD = 10
#: Documents in the sample that shows which n-grams are in so many documents that their rows stay where they are, and how often such an n-gram is in it.
SAMPLE, OFTEN = 20_000, 20
#: At most so many of these n-grams are told apart (their list goes to every task).
MOST_OFTEN = 1 << 16
#: n-grams of the sets in one pack of a group.
PACK = 1 << 19
#: Up to so many ids are sent to every task; beyond, the join shuffles.
FEW_IDS = 500_000
#: n-grams on one step of a path of the trie, and n-grams looked up at a time.
RUN, AT_ONCE = 32, 1 << 22


def _least(n, percent: int):
    """n-grams that a set of ``n`` shares with any partner, at least."""
    return -(-n * percent // 100)


def prefixes(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, ``n`` (size of the set), ``h1, h2`` (hash of the set), ``first`` (its first n-grams in the order of hashes)."""
    field = docs.schema[id_col]

    def run(batches):
        for rows, data, off in slices(batches, "_text"):
            values, bounds = shingled(data, off, shingle)
            n = np.diff(bounds)
            has = np.flatnonzero(n)
            h = np.zeros((2, len(n)), U)
            if len(has):
                h[0, has], h[1, has] = mix(np.add.reduceat(mix(values), bounds[:-1][has])), mix(np.add.reduceat(mix(values ^ U(0xABCDEF)), bounds[:-1][has]))
            size = np.minimum(n, n - _least(n, percent) + _least(n, AHEAD))
            begin = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(begin[-1]) - np.repeat(begin[:-1] - bounds[:-1], size)
            first = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), *(pa.array(x.view(np.int64)) for x in h), first], [id_col, "n", "h1", "h2", "first"])

    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {field.dataType.simpleString()}, n long, h1 long, h2 long, first array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, n, grams) of the documents in ``ids`` (node)."""
    few = ids.count() <= FEW_IDS
    mine = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("_text")).join(F.broadcast(ids) if few else ids, "node", "left_semi")

    def run(batches):
        for rows, data, off in slices(batches, "_text"):
            values, bounds = shingled(data, off, shingle)
            grams = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds)), grams], ["node", "n", "grams"])

    return mine.mapInArrow(run, "node long, n long, grams array<long>")


def shared_grams(sets: DataFrame, column: str) -> DataFrame:
    """(node, n, key) for each n-gram in ``column`` that several nodes have; keys are in the global order.

    The key has in front how many nodes have the n-gram (five bits, by powers
    of two), behind that 58 bits of its hash. N-grams that a sample shows to be
    in very many nodes (thousandths of all) come last; so their rows need not
    meet to be counted.
    """
    total = sets.count()
    drawn = sets.filter(F.pmod(F.xxhash64("node"), F.lit(max(total, 1))) < SAMPLE)
    often = drawn.select(F.explode(column).alias("gram")).groupBy("gram").count().filter(F.col("count") >= OFTEN)
    often = written(often.orderBy(F.desc("count"), "gram").limit(MOST_OFTEN).select("gram", F.lit(True).alias("often")), "often")
    rows = sets.select("node", "n", F.explode(column).alias("gram")).join(F.broadcast(often), "gram", "left")
    counted = rows.filter("often is null").withColumn("df", F.count("*").over(Window.partitionBy("gram"))).filter("df > 1")
    rare = counted.select("node", "n", "gram", F.least(F.floor(F.log2("df")), F.lit(30)).cast("long").alias("level"))
    both = rare.union(rows.filter("often").select("node", "n", "gram", F.lit(31).cast("long")))
    return both.select("node", "n", F.shiftleft("level", 58).bitwiseOR(F.shiftrightunsigned("gram", 6)).alias("key"))


class Trie:
    """Sets of numbers, each in ascending order, as paths of steps of RUN numbers; sets that agree on a step and all before it share it.

    Each level holds the steps at one depth: where a step's numbers stand, its
    parent, its children, the sets that end with it, and over all sets below
    it the smallest whole size and the greatest length.
    """

    def __init__(self, numbers: np.ndarray, bounds: np.ndarray, n: np.ndarray):
        size = np.diff(bounds)
        raw = numbers.astype(">i4").tobytes()
        order = np.array(sorted(range(len(size)), key=lambda i: raw[4 * bounds[i] : 4 * bounds[i + 1]]), np.int64)
        common = np.full(len(order), -1, np.int64)
        for k in range(1, len(order)):
            x, y = (numbers[bounds[i] : bounds[i + 1]] for i in order[k - 1 : k + 1])
            m = min(len(x), len(y))
            differ = x[:m] != y[:m]
            common[k] = int(differ.argmax()) if differ.any() else m
        self.numbers, self.levels = numbers, []
        length, begin, whole = size[order], bounds[:-1][order], n[order]
        above = np.zeros(len(order), np.int64)
        depth = 0
        while len(live := np.flatnonzero(length > depth)):
            end = np.minimum(depth + RUN, length[live])
            new = np.ones(len(live), bool)
            if len(live) > 1:
                agree = np.minimum.reduceat(common[: live[-1] + 1], live[:-1] + 1)
                new[1:] = (agree < end[1:]) | (end[1:] != end[:-1])
            first = np.flatnonzero(new)
            at = np.cumsum(new) - 1
            parent = above[live[first]]
            if self.levels:
                steps = len(self.levels[-1]["start"])
                self.levels[-1]["children"] = np.searchsorted(parent, np.arange(steps + 1))
            last = np.flatnonzero(length[live] <= depth + RUN)
            self.levels.append({
                "start": begin[live[first]] + depth, "stop": begin[live[first]] + end[first], "depth": end[first],
                "least": np.minimum.reduceat(whole[live], first), "longest": np.maximum.reduceat(length[live], first),
                "ends": np.searchsorted(at[last], np.arange(len(first) + 1)), "sets": order[live[last]],
            })
            above[live] = at
            depth += RUN
        if self.levels:
            self.levels[-1]["children"] = np.zeros(len(self.levels[-1]["start"]) + 1, np.int64)

    def partners(self, queries: list[np.ndarray], n: np.ndarray, sizes: np.ndarray, percent: int, distinct: int):
        """(query, set) of all sets similar enough to each query; n: whole sizes of queries; sizes: those of the sets."""
        has = np.zeros((len(queries), distinct), bool)
        for i, x in enumerate(queries):
            has[i, x] = True
        after = np.cumsum(has[:, ::-1], axis=1, dtype=np.int32)[:, ::-1]  # query's numbers from here on
        after = np.concatenate([after, np.zeros((len(queries), 1), np.int32)], axis=1)
        steps = len(self.levels[0]["start"])
        q, at, overlap = np.repeat(np.arange(len(queries)), steps), np.tile(np.arange(steps), len(queries)), np.zeros(len(queries) * steps, np.int64)
        found_q, found = [], []
        for level in self.levels:
            need = -(-percent * (n[q] + level["least"][at]) // (100 + percent))
            able = overlap + np.minimum(level["longest"][at] - (level["depth"] - level["stop"] + level["start"])[at], after[q, self.numbers[level["start"][at]]]) >= need
            q, at, overlap, need = q[able], at[able], overlap[able], need[able]
            if not len(q):
                break
            width = (level["stop"] - level["start"])[at]
            first = np.cumsum(width) - width
            place = np.arange(first[-1] + width[-1]) + np.repeat(level["start"][at] - first, width)
            overlap = overlap + np.add.reduceat(has[np.repeat(q, width), self.numbers[place]].astype(np.int64), first)
            able = overlap + np.minimum((level["longest"] - level["depth"])[at], after[q, self.numbers[level["stop"][at] - 1] + 1]) >= need
            q, at, overlap = q[able], at[able], overlap[able]
            x, sets = _expanded(level["ends"], at)
            sets = level["sets"][sets]
            near = (100 + percent) * overlap[x] >= percent * (n[q[x]] + sizes[sets])
            found_q.append(q[x][near])
            found.append(sets[near])
            x, at = _expanded(level["children"], at)
            q, overlap = q[x], overlap[x]
        return (np.concatenate(found_q), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _expanded(bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``at`` the numbers from bounds[at] to bounds[at + 1]: which of ``at``, and the number."""
    count = bounds[at + 1] - bounds[at]
    x = np.repeat(np.arange(len(at)), count)
    return x, np.arange(len(x)) - np.repeat(np.cumsum(count) - count - bounds[at], count)


def spanning_links(sets: np.ndarray, bounds: np.ndarray, n: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (positions of sets) that join all components which links of the group join; at most one less than there are components.

    Every set outside the largest component, as it is by then, is taken down
    the trie; so for each link between components one end is asked for.
    """
    values, rank = np.unique(sets, return_inverse=True)
    # Frequent n-grams come first in the trie, as more sets begin alike.
    rank = len(values) - 1 - rank
    order = np.lexsort((rank, np.repeat(np.arange(len(n)), np.diff(bounds))))
    rank = rank[order]
    trie = Trie(rank, bounds, n)
    label = np.unique(component, return_inverse=True)[1]
    asked = np.zeros(len(n), bool)
    links: list[tuple[int, int]] = []
    most = max(1, min(AT_ONCE // (len(values) + 1), AT_ONCE // (RUN * len(trie.levels[0]["start"]))))
    some = 1
    while True:
        todo = np.flatnonzero(~asked & (label != np.bincount(label).argmax()))
        if not len(todo):
            return links
        todo = todo[:: -(-len(todo) // some)][:some]
        asked[todo] = True
        q, i = trie.partners([rank[bounds[k] : bounds[k + 1]] for k in todo], n[todo], n, percent, len(values))
        across = label[todo[q]] != label[i]
        for a, b in zip(todo[q[across]].tolist(), i[across].tolist(), strict=True):
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
                links.append((a, b))
        some = min(2 * some, most)


def group_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components within each group; members: key, part, other, node, n, component, set."""

    def run(group: pa.Table) -> pa.Table:
        column = group.column("set").combine_chunks()
        node, n, component = (group.column(x).to_numpy() for x in ("node", "n", "component"))
        links = spanning_links(column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))]), n, component, percent)
        a, b = ([node[x[k]] for x in links] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy("key", "part", "other").applyInArrow(run, "a long, b long")


def packed(members: DataFrame, pairs: bool) -> DataFrame:
    """``members`` (key, ..., set) with ``part`` and ``other``: groups of more than PACK n-grams are cut; with ``pairs``, each two packs meet."""
    sizes = members.groupBy("key").agg(F.ceil(F.sum(F.size("set").cast("long")) / PACK).alias("parts"))
    own = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node", "key"), "parts")).withColumn("other", F.col("part"))
    if not pairs:
        return own
    rest = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: p != F.col("part"))
    met = F.when(F.col("parts") == 1, F.array(F.col("part"))).otherwise(rest)
    own = own.withColumn("met", F.explode(met))
    return own.withColumn("other", F.greatest("part", "met")).withColumn("part", F.least("part", "met"))


def by_prefix(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of sets (node, n, grams): groups (node, n, key, home) by the n-grams in their prefixes, and (node, n, set) of what nodes share, in the global order."""
    own = F.ceil(F.col("n") * percent / 100)
    ordered = shared_grams(sets, "grams").groupBy("node", "n").agg(F.sort_array(F.collect_list("key")).alias("set"))
    ordered = written(ordered.filter(F.size("set") >= own), "ordered")
    kept = F.slice("set", 1, (F.size("set") - own + 1).cast("int"))
    postings = ordered.select("node", "n", F.explode(kept).alias("key"), F.element_at(kept, 1).alias("home"))
    several = postings.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    return written(postings.join(several, "key"), "postings"), ordered.select("node", "n", "set")


def links_across(postings: DataFrame, sized: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links`` and those that join what components these leave, as far as any link does; groups and sets as :func:`by_prefix` gives them."""
    for turn in range(2):
        placed = _open(postings, components(links))
        drawn = placed.groupBy("key", "component").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", "key", F.lit(turn))).alias("x"))
        drawn = drawn.join(_once(drawn, "component"), "key").select("key", "component", "x.*")
        links = links.union(written(group_links(packed(drawn.join(sized, ["node", "n"]), False), percent), "links"))
    placed = _open(postings, components(links))
    return links.union(written(group_links(packed(placed.join(_once(placed, "node"), "key").join(sized, ["node", "n"]), True), percent), "links"))


def linked(docs: DataFrame, shingle: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_shingles``, ``component_id``, one row for each row of ``docs``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their sets of distinct word n-grams (ASCII letters lower-cased, words as
    runs of anything but ASCII white space; shorter texts are one n-gram).
    ``component_id`` is the smallest id reachable over links. Null, empty and
    blank texts have no n-gram and are linked with nothing. Equal sets are one
    node. Rows that share an id are one document with the links of all its
    texts; rows without an id are never linked and have no component. An empty
    table gives an empty result. Other columns are not read.
    """
    first = written(prefixes(docs.withColumn(id_col, F.col(id_col).cast("long")), shingle, percent, id_col, text_col), "prefixes")
    nodes = written(first.filter(f"n > 0 and `{id_col}` is not null").groupBy("h1", "h2", "n").agg(F.min(id_col).alias("node")), "nodes")
    of_nodes = first.select(F.col(id_col).alias("node"), "h1", "h2", "n", "first").join(nodes, ["node", "h1", "h2", "n"], "left_semi").select("node", "n", "first")
    own = F.ceil(F.col("n") * percent / 100)
    counts = shared_grams(written(of_nodes, "first"), "first").groupBy("node", "n").agg(F.count("*").alias("c"))
    able = written(counts.filter(F.col("c") >= F.ceil(own * AHEAD / 100)).select("node").distinct(), "able")
    sets = written(whole_sets(docs, able, shingle, id_col, text_col), "sets")
    postings, sized = by_prefix(sets, percent)
    home = postings.filter("key = home").select("node", "n", "key").join(sized, ["node", "n"]).withColumn("component", F.col("node"))
    links = written(group_links(packed(home, False), percent).union(_of_one_id(first, nodes, id_col)), "links")
    links = links_across(postings, sized, links, percent)
    found = nodes.join(components(links), "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component_id"))
    out = first.select(id_col, "n", "h1", "h2").join(found, ["h1", "h2", "n"], "left")
    return out.select(id_col, F.col("n").alias("n_shingles"), F.when(F.col(id_col).isNotNull(), F.coalesce("component_id", id_col)).alias("component_id"))


def _of_one_id(first: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """Links between the nodes of rows that share an id."""
    of_ids = first.select(F.col(id_col).alias("id"), "h1", "h2", "n").join(nodes, ["h1", "h2", "n"]).filter("id is not null")
    ends = of_ids.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("high")).filter("a < high").select("id", "a")
    return of_ids.join(ends, "id").select("a", F.col("node").alias("b"))


def _open(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, n, component) of the groups that hold several components."""
    placed = written(postings.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("key")
    return written(placed.join(mixed, "key"), "open")


def _once(groups: DataFrame, column: str) -> DataFrame:
    """One key of all groups that have the same values in ``column``."""
    alike = groups.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64(column)).alias("x"), F.bit_xor(F.xxhash64(column, F.lit(1))).alias("y"))
    return alike.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key")


COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w
), e AS (
  SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
