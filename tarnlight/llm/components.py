"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014).

DataFrame operations only: least neighbours are aggregated before the shuffle, no group is collected, and each step is
written to the shared folder. Links between a hub and a great many others are split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) for every node that has a link to another; ids are longs, never null."""
    now = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "links")
    state = _state(now)
    while state[0]:
        # large star: each node's greater neighbours go to the least of it and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = saved(large, "links")
        # small star: each node's lesser neighbours, and itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        small = saved(small, "links")
        then = _state(small)
        dropped(now)
        dropped(large)
        now = small
        if then == state:
            break
        state = then
    # by now every link goes from a node to the least of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
