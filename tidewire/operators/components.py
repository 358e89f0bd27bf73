"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.sources.shared import Scratch

ROUNDS = 60


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` (its smallest node) of every node of ``links`` (a, b) with a link to another.

    Every node points to a smaller one or itself. A round offers the grandparents of
    a node's neighbours to the node and to its parent, and shortens paths (FastSV,
    Zhang, Azad and Hu 2020). Offers are minima that combine before the shuffle, and
    the joins have one side with unique keys, so a node with very many links is
    split by adaptive execution.
    """
    pairs = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = scratch.keep(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v").distinct(), "edges")
    nodes = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent")), "nodes")
    for _ in range(ROUNDS):
        up = nodes.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        with_grand = scratch.keep(nodes.join(up, "parent").select("node", "parent", "grand"), "grand")
        near = edges.join(with_grand.select(F.col("node").alias("v"), F.col("grand").alias("offer")), "v").groupBy("u").agg(F.min("offer").alias("offer"))
        told = with_grand.join(near, with_grand.node == near.u)
        offers = told.select(F.explode(F.array(F.struct("node", F.least("parent", "grand", "offer").alias("parent")), F.struct(F.col("parent").alias("node"), F.col("offer").alias("parent")))).alias("o"))
        after = scratch.keep(offers.groupBy("o.node").agg(F.min("o.parent").alias("parent")), "nodes")
        before = with_grand.select("node", F.col("parent").alias("was"), "grand")
        moved = after.join(before, "node").where((F.col("parent") != F.col("was")) | (F.col("grand") != F.col("was"))).limit(1).count()
        nodes = scratch.keep(after, "nodes", instead_of=nodes)
        if not moved:
            return nodes.select("node", F.col("parent").alias("component"))
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
