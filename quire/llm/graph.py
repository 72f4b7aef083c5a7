"""Connected components in Spark, by hooking every node to its least neighbour and contracting the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .space import cut_large as cut


def components(edges: DataFrame) -> DataFrame:
    """node, label for all nodes of the undirected ``edges`` (a, b): nodes have one label if and only if a path joins them.

    The label is some node of the component. Each round hooks a node to its least neighbour (counts are combined before the
    shuffle, so hubs are no burden), follows the hooks twice, and contracts; the number of nodes at least halves, and no
    round holds more than its edges. Node ids should be hashes: then chains contract fast too. Every round is written to
    the shared folder, in a form that lets Spark split a hub's rows in the joins.
    """
    now = cut(_normal(edges), "edges")
    maps: list[DataFrame] = []
    while n := now.count():  # read from the files' footers
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "hooks", rows=2 * n)
        above = near.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        hooks = cut(near.join(above, "up").select("node", F.col("upper").alias("label")), "hooks", done=(near,), rows=2 * n)
        maps.append(hooks)
        to_a, to_b = (hooks.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
        now = cut(_normal(now.join(to_a, "a").join(to_b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))), "edges", done=(now,), rows=n)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    known = maps.pop()
    while maps:
        earlier = maps.pop()
        last = known.select(F.col("node").alias("label"), F.col("label").alias("final"))
        known = cut(earlier.join(last, "label", "left").select("node", F.coalesce("final", "label").alias("label")), "labels", done=(earlier, known), rows=earlier.count())
    return known


def _normal(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
