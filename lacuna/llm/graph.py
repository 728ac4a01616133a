"""Connected components of links between rows, by alternating large and small stars.

Every round is two grouped minima and two joins, and one table in the shared folder;
nothing but two sums per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import discard, staged

#: Links are so many times fewer than what they were found in, for the number of tasks.
SHARE = 16


def _minima(pairs: DataFrame) -> DataFrame:
    """(u, m): least of u and its neighbours v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each linked id reaches. links: columns a and b, any order.

    Ids without links do not appear. Repeated links and links of an id to itself are fine.
    """
    edges = staged(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", SHARE)
    told = None
    while True:  # stars in turn settle, however long the paths are
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = large.distinct()
        least = _minima(large)  # in large u > v, so these are all of u's lesser neighbours
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, staged(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "small-star", SHARE)
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == told:
            break
        told = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
