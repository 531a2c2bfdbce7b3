"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.scratch import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b); component is the smallest node reachable.

    Rounds of contraction: every node points to its smallest neighbour if that
    is smaller, chains of pointers are shortened, and links are redrawn between
    the nodes pointed to, until none is left. A round at least halves the nodes
    that still have links. Nothing but emptiness checks reaches the driver.
    Loops, repeated links and nulls are ignored; no links give no rows.
    """
    clean = lambda x: x.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = clean(links)
    labels = None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        hop = written(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "hop")
        while True:
            ahead = hop.select(F.col("node").alias("to"), F.col("to").alias("further"))
            hop = written(hop.join(ahead, "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), "hop")
            if hop.filter("moved").isEmpty():
                break
            hop = hop.drop("moved")
        hop = hop.drop("moved")
        if labels is None:
            labels = hop.select("node", F.col("to").alias("component"))
        else:
            step = hop.select(F.col("node").alias("component"), "to")
            labels = written(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        left = edges.join(hop.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        edges = written(clean(left.join(hop.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
