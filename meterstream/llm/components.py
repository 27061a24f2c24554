"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on rows (u, v). Large: each larger neighbour links to the least of the neighbourhood. Small: each smaller one does, and the node itself.

    The least neighbours are written out, so that the join's sides are both shuffled for it alone
    and Spark can split a hub's rows over tasks.
    """
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node, component`` for each node with a link; the component is named by its least node.

    Sums go before each shuffle and every round is written out, so a hub costs no task more than
    the links that it has there. Links from a node to itself and null ends are ignored.
    """
    with scratch():
        return saved(_components(links, most_rounds), "components", outlive=True)


def _components(links: DataFrame, most_rounds: int) -> DataFrame:
    current = saved(links.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        current = saved(_star(saved(_star(current, large=True), "links"), large=False), "links")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("the components did not settle")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
