"""Connected components of a link table, by alternating large and small stars.

Every round is two aggregations and two joins over the links; rounds grow with
the logarithm of the longest chain. Links never leave the executors: a round's
links are a written table, and only their number and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contagrid.llm.common import hot_split_join, written


def _lowest(links: DataFrame) -> DataFrame:
    """u, low: the smallest of each u and its neighbours."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = hot_split_join(both.where("v > u"), _lowest(both), ["u"], "inner")
    return joined.select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    low = _lowest(links)
    joined = hot_split_join(links, low, ["u"], "inner")
    moved = joined.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """node, component (its component's smallest node) for each node of ``links`` (a, b; any integers, in any order).

    Links of a node to itself and rows with a null are ignored; repeated links
    count once; no link gives no row. Nodes without links have no row.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    links = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    seen = None
    while True:
        links = written(links, "links")
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        links = _small_star(_large_star(links).distinct()).where("u > v").distinct()
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots)
