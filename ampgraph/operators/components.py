"""Connected components of a link table, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node that links reach. Nodes may be of any type with an order.

    Large-star and small-star rounds (Kiveris et al., 2014) on a shrinking edge table, until it is a forest of
    stars: each round is two aggregations with partial minima and two equi-joins, and ends as a table in the shared
    folder, so lineage stays short; tables of earlier rounds go. The driver sees counts alone. Null ends and
    self-links are ignored; repeated links count once; an empty table gives an empty one.
    """
    edges = materialize(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null")
        .distinct(),
        "links",
    )
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima as tables of their own, so that the join of a hub's many rows can be split between tasks
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(edges, low, large, least)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node links to one node at most, and none of those links on."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return n == nodes and not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").take(1)
