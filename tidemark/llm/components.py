"""Connected components of a link table, by contraction.

Each round points every node to its least neighbour, or to itself, and replaces the links by those between the nodes
pointed to.  A node that others point to takes them in, so the links shrink quickly; every table is written to the shared
folder, nothing is collected, and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, spread_joins, written


def components(links: DataFrame) -> DataFrame:
    """node, label: one node of its component for every node of links (a, b), the same for all of it; none for no links."""
    rounds = []
    edges = links.select("a", "b")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        heads = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "heads")
        rounds.append(heads)
        # a node with many links is spread over tasks; so are, below, the nodes of a large component
        ends = [(heads.select(F.col("node").alias(c), F.col("label").alias(to)), c) for c, to in (("a", "x"), ("b", "y"))]
        moved = spread_joins(edges, ends)
        edges = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            break
    labels = rounds.pop()
    while rounds:
        labels = written(followed(rounds.pop(), labels), "labels")
    return labels


def followed(first: DataFrame, then: DataFrame) -> DataFrame:
    """node, label of first, each label replaced by its own label in then, where it has one."""
    then = then.select(F.col("node").alias("label"), F.col("label").alias("further"))
    return spread_join(first, then, "label", "left").select("node", F.coalesce("further", "label").alias("label"))


def joined_classes(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The labels of the components of the links that made labels and of more (a, b) together."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    edges = spread_joins(more, [(of("a"), "a"), (of("b"), "b")], "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    between = components(written(edges.where("a <> b").distinct(), "between"))
    new = between.join(labels.select("node"), "node", "left_anti")  # nodes that had no link before
    return written(followed(labels, between).unionByName(new), "labels")
