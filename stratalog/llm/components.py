"""Connected components of links, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.base import cut, drop_table


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a long, b long): the smallest id
    that links reach, itself included.

    Large-star and small-star rounds (Kiveris et al., 2014): each round links a
    node's neighbours to the smallest of them, until all links are stars around a
    smallest id; links that are so at the start take no round. Links stay rows; the
    driver sees one number per round. A node of many links is one group
    of a minimum and a join, both of which Spark splits or pre-aggregates.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: larger neighbours of u go to the least of its neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours of u, and u, go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct())
        drop_table(edges)
        edges = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v that is no u."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
    return odd.agg(F.count(F.lit(1))).first()[0] == 0
