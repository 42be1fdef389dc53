"""Connected components of an edge table, without collecting links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable from node, for every node of an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the number of edges never grows, each round needs
    two shuffles, and a component of diameter d is flat after O(log d) rounds. Hot nodes are no join key: a star step is
    one aggregation and one join on the node. Every round is written to the checkpoint folder. Loops, repeated edges and
    null ends are fine (an edge with a null end links nothing); an empty table gives an empty one.
    """
    pairs = edges.select(F.col(f"`{a}`").alias("u"), F.col(f"`{b}`").alias("v")).where("u is not null and v is not null")
    e = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # edges are distinct, so count and sum of digests tell whether a round changed anything
    state = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u is linked to the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, are linked to the least of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = cut(small.unionByName(e.where("u = v")).distinct())
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.unionByName(e.select(F.col("v").alias("u"), "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
