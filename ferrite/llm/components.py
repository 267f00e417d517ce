"""Connected components of a table of links by alternating large and small stars, on any number of executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _minima(links: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours v. Written, so that the join that follows has two plain exchanges."""
    return common.materialise(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")


def connect(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) of every node with a link, roots included; root is the least node of its component.

    ``links`` has bigint columns a and b. A star with any number of leaves is narrow rows under one key, which partial
    aggregation and AQE's skew join take apart. Repeated links and links of a node to itself change nothing. Rounds grow
    with the logarithm of the longest chain; should ``rounds`` not do, that is an error, never an unfinished answer.
    """
    fine = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = common.materialise(fine.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _fingerprint(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _minima(both)
        large = both.join(near, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.materialise(large.distinct(), "large-star")
        minima = _minima(large)
        small = large.join(minima, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(minima.select("u", F.col("m").alias("v")))
        after = common.materialise(small.where("u <> v").distinct(), "small-star")
        now = _fingerprint(after)
        common.discard(edges, near, large, minima)
        edges = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
