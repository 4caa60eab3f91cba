"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import cut


def contracted(links: DataFrame, passes: int = 2) -> DataFrame:
    """Fewer links ``a, b`` that connect the same nodes.

    A node keeps the link to its smallest neighbour; its other neighbours are linked with that one instead. In a group
    whose members meet in many buckets the smallest of each bucket are few, so that what is left after two passes is
    hardly more than a link a node. The neighbours of a node that come together here are at most one for each bucket
    that the node is in.
    """
    for _ in range(passes):
        near = links.groupBy("a").agg(F.collect_set("b").alias("near")).withColumn("b", F.array_min("near"))
        kept = F.concat(F.array(F.struct("a", "b")), F.transform(F.array_remove("near", F.col("b")), lambda x: F.struct(F.greatest(x, "b").alias("a"), F.least(x, "b").alias("b"))))
        links = near.select(F.explode(kept).alias("k")).select("k.a", "k.b")
    return links.distinct()


def connected(links: DataFrame, left: str = "a", right: str = "b", rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``node, component`` for every node that has a link; the component is its smallest node.

    Large-star links each larger neighbour to the smallest of a node's neighbourhood, small-star each smaller one and the
    node itself. The links converge to stars in a logarithmic number of rounds; the sum of the smaller ends tells when
    nothing changes. Minima are aggregated before the shuffle, so a hub costs one row per partition; they are grouped
    under another key than that of the join that hands them back, so that the join gets exchanges which Spark splits when
    a key is skewed. What a round hands to the next has a partition for ``rows`` links, if that is given, and no more than
    the shuffle has: few links else make as many tiny files and tasks as there are shuffle partitions, in every round.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u != v").distinct()
    edges, before = cut(edges), None
    for _ in range(rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum(F.col("u").cast("decimal(38,0)")).alias("t")).first()
        if not state["n"] or state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m")).select("k.u", F.least("k.u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m")).select("k.u", "m")
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m")).where("u != v").distinct()
        edges = cut(small.coalesce(-(-state["n"] // rows)) if rows else small)
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
