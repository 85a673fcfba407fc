"""Connected components by joins alone: nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.common import stored


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of an edge.

    ``edges`` has the columns ``a`` and ``b``, any type that compares. Each round
    links a node's neighbours to the smallest of them, first all that are larger,
    then all that are smaller, until every node hangs on its component's smallest;
    the rounds needed grow with the logarithm of a component's size, and a hub's
    neighbours are never gathered, only their minimum is. ``rounds`` stops early: then nodes
    of one ``component`` do belong together, but a component may be in parts.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = stored(both.distinct(), "links")
    done = 0
    while rounds is None or done < rounds:
        links = stored(_small_star(_large_star(links)), "links")
        done += 1
        if _are_stars(links):
            break
    hung = links.groupBy("u").agg(F.min("v").alias("v"))
    roots = links.select(F.col("v").alias("u")).distinct().join(hung, "u", "left_anti")
    return hung.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select(F.col("u").alias("node"), F.col("u").alias("component"))
    )


def _are_stars(links: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none: another round moves nothing."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        links.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node hang on the smallest of it and its neighbours."""
    around = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (
        around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang on the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    smaller = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
