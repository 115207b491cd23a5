"""Connected components of a graph of links, by alternating stars, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import discard, settle, spread_join


def _nearest(links: DataFrame, total: int) -> DataFrame:
    """Each end of a link with m, the least node of its neighbourhood (itself counts). A hub's links stay spread."""
    least = links.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("size"))
    return spread_join(links, least, "u", "size", total, "v").select("u", "v", F.least("u", "least").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """links (u, v: longs) to (node, component): the least node that can be reached, for every node of a link.

    Each round makes large stars (every larger neighbour points to the least one), then small stars (so does every
    smaller one); rounds are few, about the logarithm of the longest path. Only a count and a checksum come to the
    driver. A node's neighbours are never gathered: the least one is an aggregate, joined back.
    """
    now = settle(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    check = (F.count("*"), F.bit_xor(F.xxhash64("u", "v")))
    seen = tuple(now.agg(*check).first())
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both, 2 * seen[0]).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct(), "links")
        small = _nearest(large, seen[0])
        made = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))
        before, now = now, settle(made.distinct(), "links")
        discard(before, large)
        state = tuple(now.agg(*check).first())
        if state == seen:
            break
        seen = state
    # at the end every link leads from a node to its component's least node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
