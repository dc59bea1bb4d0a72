"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step: every node's neighbours (the larger, or the smaller and itself) are linked to its smallest neighbour."""
    both = edges if not larger else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if larger:
        linked = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that reaches a smaller one.

    links: pairs of long ids in either order; repeats and loops do no harm, an empty table gives an empty one. Each
    round is one large-star and one small-star step; the table is written to the shared folder after each, and the
    rounds end when it no longer changes (a number of rounds of the order of log² of the largest component). Sums and
    minima are taken before rows are shuffled; the joins are plain equi-joins, which adaptive execution splits on hot
    nodes. No link leaves the executors.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = materialize(links.select(high.alias("a"), low.alias("b")).filter("a <> b").distinct(), "links")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = state(edges)
    while was[0]:
        edges = materialize(_star(_star(edges, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), "links")
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
