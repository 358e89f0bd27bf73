"""Connected components of a link table, by alternating star contraction.

Large-star and small-star steps (Kiveris et al. 2014) touch each edge a bounded
number of times a round and need few rounds; every step is a min-aggregate with
map-side combining and a join that adaptive execution can split, so a node with
a third of all links never has them gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._store import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with a link; component: its smallest node.

    Null ends, self-links and repeated links are ignored. An empty table gives no rows.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    links = materialise(links, "links")
    before = None
    for _ in range(max_rounds):
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if (now.n, now.h) == before or now.n == 0:
            break
        before = (now.n, now.h)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written out, so that the join below has plain exchanges on both sides, which can be split at a hot node.
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "links-least")
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        large = materialise(large, "links-large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u != v")
            .distinct()
        )
        links = materialise(small, "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
