"""Connected components of a stored link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of ``links`` (a, b: long).

    Each round moves every node to the neighbour, or itself, that is first under one of three hash orders, which contracts
    the graph by a constant factor, whatever its shape and its numbering; then the moves are followed. Nodes without
    links are not returned.
    """
    links = common.stored(links.select("a", "b").where("a <> b").distinct(), "links")
    at = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("now", F.col("node"))
    edges, turn = links, 0
    while edges.limit(1).count():
        # a few orders by turns: each is code that Spark generates, compiles and keeps
        by = F.lit(turn % 3)
        order = F.struct(F.xxhash64("b", by), "b")
        both = edges.union(edges.select("b", "a"))
        own = F.struct(F.xxhash64("a", by), F.col("a").alias("b"))
        to = both.groupBy("a").agg(F.min(order).alias("first")).select("a", F.least(F.col("first"), own)["b"].alias("to"))
        to = common.stored(to, f"moves-{turn}")
        left = edges.join(to.withColumnRenamed("to", "p"), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("q")), "b")
        edges = common.stored(left.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), f"edges-{turn}")
        at = at.join(to, at["now"] == to["a"], "left").select("node", F.coalesce("to", "now").alias("now"))
        turn += 1
        if turn % 4 == 0:
            at = common.stored(at, f"places-{turn}")
    at = common.stored(at, "places")
    names = at.groupBy("now").agg(F.min("node").alias("component"))
    return common.stored(at.join(names, "now").select("node", "component"), "components")


def merged(place: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that made the stored ``place`` and of further ones, which are looked at alone."""
    of = lambda c: place.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    parts = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(parts)
    nodes = place.unionByName(moved.select("node", F.col("node").alias("component")).join(place.select("node"), "node", "left_anti"))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return common.stored(nodes.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
