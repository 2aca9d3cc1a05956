"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step is an aggregate and a join; each round is written to the shared folder. A hub's links are never gathered in
one task: a node's smallest neighbour is a partial aggregate, and the join back splits where it is skewed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v), u > v. Large: neighbours above a node move to its smallest neighbour; small: those below."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("at"), F.least("u", "low").alias("low"))
    moved = both.join(low, both["u"] == low["at"])
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select(F.col("at").alias("u"), F.col("low").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of all nodes but the smallest of each component; links: (a, b) of longs, in any order."""
    scratch = scratch or Scratch(links.sparkSession)
    name = f"links-{uuid.uuid4().hex}"
    now = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") > F.col("v")).distinct(), name)
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        last, name = name, f"stars-{uuid.uuid4().hex}"
        now = scratch.keep(_star(_star(now, True), False), name)
        scratch.drop(last)
        # Stars: each node but the smallest has one link, down to one that has none.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
        ends = ends.unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        unlike = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1")
        if unlike.agg(F.count("*")).first()[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
