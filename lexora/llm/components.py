"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import cut
from lexora.shared import spent


def _between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The distinct undirected links, without loops."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of edges (columns a and b, 64-bit integers); a component's nodes share a root.

    In each round every node goes to its least neighbour or itself, and links
    are drawn between those; what is written shrinks until no link is left.  As
    ids are hashes, and so in random order along any path, rounds grow with the
    logarithm of a component's size.  Tables of rounds past are deleted.  No
    node's links meet in one task: least neighbours are aggregated before the
    shuffle, and the joins are between written tables, which adaptive execution
    can split.
    """
    links, labels, first = cut(_between(edges, "a", "b"), "links"), None, None
    while links.limit(1).count():
        both = links.union(links.select(F.col("v"), F.col("u")).toDF("u", "v"))
        to = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")), "least")
        if labels is None:
            first, labels = to, to.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            before, labels = first or labels, cut(labels.join(to, labels["root"] == to["u"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            spent(before)
            first = None
        a, b = to.toDF("u", "a"), to.toDF("v", "b")
        before, links = links, cut(_between(links.join(a, "u").join(b, "v"), "a", "b"), "links")
        spent(before, *([to] if first is not to else []))
    if labels is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
