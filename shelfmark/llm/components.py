"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.session import release, settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    ``edges`` has one row per link in either direction; repeats, loops and null ends are dropped, and
    nodes without a link don't appear. Only minima are gathered per node, so a node that a third of
    all links share is a partial aggregate and a join that Spark can split. Each round goes on from a
    written table in the shared checkpoint folder.
    """
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct()
    now = settle(now, "edges")
    seen = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        last, now = now, settle(small.where("u > v").distinct(), "edges")
        release(last)
        state = _state(now)
        if state == seen:
            break
        seen = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
