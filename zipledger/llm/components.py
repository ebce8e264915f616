"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zipledger.llm.common import stage


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of u and its partners; hubs are pre-aggregated."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs["u"] == least["x"]).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _least(down)
    mine = starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = starred.select("u", F.col("m").alias("v"))
    return mine.union(own).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (u, v); component is the least node reachable.

    Every round is written and read again; only counts come to the driver.
    """
    edges = stage(edges.filter("u <> v").distinct(), "edges")
    before = None
    while True:
        edges = stage(_small(_large(edges).distinct()).distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component")).distinct()
