"""Connected components of a link table by alternating large-star and small-star steps.

Only (node, least neighbour) pairs move; a hub's links are reduced map-side by
``min`` and joined back, so no neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm._tables import discard, store


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs directly on one least node that hangs on none."""
    n, nodes = edges.agg(F.count("*"), F.countDistinct("u")).first()
    return n == nodes and edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: columns u, v (any orderable type). Returns node, component (the least node reachable), for linked nodes only.

    Null ends, self-links and repeated links are ignored; an empty table gives an empty table.
    """
    edges = store(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        spent, edges = edges, store(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        discard(spent)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
