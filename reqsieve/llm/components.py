"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.common import discard, spread_join, stored


def _starred(edges: DataFrame, large: bool, n_links: int) -> DataFrame:
    """Link the neighbours of each node (those above it, or those below and itself) to the
    least of its neighbours and itself.

    Minima are aggregated before they are joined back, and links of a node with very many stay
    where they are. A step adds at most one link a node."""
    if large:
        near = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
    else:
        near = edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
    near = near.select("a", "b")
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).selectExpr("a", "least(a, m) AS m", "n")
    linked = spread_join(near, least, "a", n_links * (2 if large else 1))
    if large:
        out = linked.where("b > a").selectExpr("b AS a", "m AS b")
    else:
        out = linked.selectExpr("b AS a", "m AS b").unionByName(least.selectExpr("a", "m AS b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node it is linked to) for every node of ``links`` (a, b) but roots."""
    edges, before = stored(links.select("a", "b").where("a <> b").distinct(), "links"), None
    n_links = edges.count()
    while True:
        for large in (True, False):
            last, edges = edges, stored(_starred(edges, large, n_links), "links")
            discard(last)
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            return edges.selectExpr("a AS node", "b AS root")
        before = state
