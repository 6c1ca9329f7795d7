"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qrelia.session import durable


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node of ``links`` (``a``, ``b``) is either below one other node only or above others only."""
    no_parent = F.lit(None).cast(links.schema["b"].dataType)
    nodes = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), no_parent.alias("b")))
    # Where a node stands above others, its row has no parent.
    seen = nodes.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.max(F.col("b").isNull()).alias("above"))
    return seen.where("lo <> hi OR (lo IS NOT NULL AND above)").agg(F.count(F.lit(1))).first()[0] == 0


def components_below(links: DataFrame) -> DataFrame:
    """(node, root), written, for every node of ``links`` (``a`` > ``b``, each pair once) that is not itself a root."""
    links = durable(links)
    while not _is_forest_of_stars(links):
        both = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # As many rows as links at most, so they need not be made distinct before the next step; joining them twice
        # from the shuffles there are takes less than writing them.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        above, own = F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))
        links = durable(large.join(floor, "a").select(F.inline(F.array(above, own))).where("a <> b").distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def downward(edges: DataFrame) -> DataFrame:
    """``edges`` (``a``, ``b``) with the larger node first, without loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def with_roots(below: DataFrame) -> DataFrame:
    """``below`` (node, root) and a row for every root."""
    return below.unionByName(below.select(F.col("root").alias("node"), "root").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (``a``, ``b``); the root is the least node of its component.

    Alternates two steps until every node is linked to its root alone: every node links its larger neighbours to its
    least neighbour, then its smaller ones. Chains are halved each time. Nodes are any type that can be ordered;
    neighbours are never collected, only their minimum is joined back.
    """
    return with_roots(components_below(downward(edges).distinct()))
