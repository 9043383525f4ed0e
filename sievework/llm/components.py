"""Connected components by alternating large-star and small-star steps on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, scratch: C.Scratch, name: str) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b); a loop-free table of links.

    Each step writes its edges to the shared folder, so lineage stays short. Minima are
    partial aggregations, written before they are joined back, the nodes with most links by
    broadcast (common.join_each).
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    links = scratch.keep(links, f"{name}-0")
    step = 0

    def stars(rows: DataFrame) -> bool:
        """Whether every larger end has one link and is no smaller end, so that all links lead to a least node."""
        ends = rows.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(rows.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ends.filter("up > 1 or up = 1 and down = 1").isEmpty()

    def with_least(rows: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
        """Rows with m, the least neighbour of u, and the table of u and m."""
        least = scratch.keep(rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-{what}-{step}")
        return C.join_each(rows, least, ["u"]), least

    while not stars(links):
        step += 1
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = with_least(both, "large")
        large = large.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        large = scratch.keep(large, f"{name}-star-{step}")
        small, low = with_least(large, "small")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        links = scratch.keep(small.filter("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-large-{step}", f"{name}-star-{step}", f"{name}-small-{step}", f"{name}-{step - 1}")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
