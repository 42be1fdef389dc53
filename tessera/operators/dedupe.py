"""Duplicate findings: inverted-index similarity join inside a block, and the clusters it spans."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.session import cut

#: Tokens of a bag whose links are found by the subsets it holds (at most some seventy); longer bags are compared pair by pair.
SMALL = 6


def _bags(df: DataFrame, id: str, block: str, bag: str, least: int) -> DataFrame:
    """(k, w, id): each bag of a block once, under its smallest id."""
    rows = df.where(F.col(id).isNotNull() & F.col(block).isNotNull() & (F.size(bag) >= least)).groupBy(F.col(block).alias("k"), F.array_sort(F.array_distinct(F.col(bag))).alias("w")).agg(F.min(id).alias("id"))
    return cut(rows.where(F.size("w") >= least))


def similar_bags(df: DataFrame, id: str, block: str, bag: str, threshold: float = 0.55, least: int = 2) -> DataFrame:
    """(a, b, jaccard): rows of one block whose token bags share at least `least` tokens and are similar or one inside the other.

    Equal bags of a block are one row (its smallest id) before the join, so copies make no pairs. A pair is found by the
    prefix of each bag in order of rarity: of n tokens, only so many can be missing that a pair must share one of the
    rarest n - ceil(threshold n) + 1 - or, for a bag inside another, its rarest token.
    """
    return _similar(_bags(df, id, block, bag, least), threshold, least)


def _similar(rows: DataFrame, threshold: float, least: int, beyond: int = 0) -> DataFrame:
    """The pairs of similar_bags, of which at least one bag has more than `beyond` tokens."""
    longer = F.greatest("na", "nb") > beyond
    freq = rows.select("k", F.explode("w").alias("t")).groupBy("k", "t").agg(F.count("*").alias("f"))
    n = F.size("w")
    terms = rows.select("k", "id", n.alias("n"), F.explode("w").alias("t")).join(freq, ["k", "t"])
    ranked = terms.withColumn("r", F.row_number().over(Window.partitionBy("k", "id").orderBy("f", "t")))
    need = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    side = lambda rows, x: rows.where("f > 1").select("k", "t", F.col("id").alias(x), F.col("n").alias(f"n{x}"))
    # similar bags share a token of both prefixes, and neither is much longer; only a bag inside another needs all tokens of the longer one
    rare = ranked.where(F.col("r") <= need)
    near = side(rare, "a").join(side(rare, "b"), ["k", "t"]).where(longer & (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9))
    inner = side(ranked.where("r = 1"), "a").join(side(ranked, "b"), ["k", "t"]).where(longer & F.expr("a <> b and na <= nb"))
    pairs = near.select("k", "a", "b").unionByName(inner.select("k", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    bags = lambda side: rows.select("k", F.col("id").alias(side), F.col("w").alias(f"w{side}"))
    both = pairs.join(bags("a"), ["k", "a"]).join(bags("b"), ["k", "b"])
    shared = F.size(F.array_intersect("wa", "wb"))
    jaccard = shared / (F.size("wa") + F.size("wb") - shared)
    inside = shared == F.least(F.size("wa"), F.size("wb"))
    return both.select("a", "b", jaccard.alias("jaccard"), shared.alias("s"), inside.alias("inside")).where((F.col("s") >= least) & (F.col("inside") | (F.col("jaccard") >= threshold))).select("a", "b", "jaccard")


def _needed(n: int, m: int, threshold: float, least: int) -> int:
    """Tokens that bags of n and m tokens must share to be linked: all of the shorter one, or the threshold's part."""
    return max(least, min(n, m, math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)))


def _stars(rows: DataFrame, threshold: float, least: int) -> DataFrame:
    """(a, b): links that span the same components as all links between bags of at most SMALL tokens.

    Two bags of n and m tokens are linked if they share a subset of _needed(n, m) tokens. All bags of n tokens that hold
    one such subset are linked to all of m tokens that do, so if there are both, all of them are one component: each
    is linked to the least of them. That takes a few rows a bag, however many bags are alike.
    """
    small = rows.where(F.size("w") <= SMALL)
    sizes = sorted(r[0] for r in small.select(F.size("w")).distinct().collect())
    keys = F.array().cast("array<struct<lo:int,hi:int,s:array<int>>>")
    for n in sizes:
        ways = [(min(n, m), max(n, m), list(c)) for m in sizes if (need := _needed(n, m, threshold, least)) <= min(n, m) for c in combinations(range(n), need)]
        if ways:
            listed = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array(*map(F.lit, c)).alias("s")) for lo, hi, c in ways])
            keys = F.when(F.size("w") == n, listed).otherwise(keys)
    held = small.select("k", "id", "w", F.size("w").alias("n"), F.explode(keys).alias("key"))
    held = held.select("k", "id", "n", "key.lo", "key.hi", F.transform("key.s", lambda i: F.get("w", i)).alias("s"))
    hubs = held.groupBy("k", "lo", "hi", "s").agg(F.min("id").alias("least"), F.count("*").alias("bags"), F.min("n").alias("fewest"), F.max("n").alias("most"))
    hubs = hubs.where("bags > 1 and fewest = lo and most = hi").drop("bags", "fewest", "most")
    return held.join(hubs, ["k", "lo", "hi", "s"]).where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()


def clusters(df: DataFrame, id: str, block: str, bag: str, threshold: float = 0.55, least: int = 2) -> DataFrame:
    """(id, cluster): exact bags of a block together, then everything linked to them, directly or not; the cluster is its smallest id.

    Links are those of similar_bags; between bags of at most SMALL tokens they are not listed, since common tokens make
    them grow as the square of the bags.
    """
    key = df.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(block).alias("k"), F.array_sort(F.array_distinct(F.col(bag))).alias("w"))
    first = key.groupBy("k", "w").agg(F.min("id").alias("first"))
    exact = key.alias("x").join(first.alias("y"), F.expr("x.k <=> y.k and x.w <=> y.w")).select("x.id", F.when(F.size("x.w") > 0, F.col("first")).otherwise(F.col("x.id")).alias("first"))
    rows = _bags(df, id, block, bag, least)
    linked = _stars(rows, threshold, least)
    if not rows.where(F.size("w") > SMALL).isEmpty():
        linked = linked.unionByName(_similar(rows, threshold, least, SMALL).select("a", "b"))
    links = connected_components(linked, "a", "b").select(F.col("node").alias("first"), "component")
    return exact.join(links, "first", "left").select("id", F.coalesce("component", "first").alias("cluster"))
