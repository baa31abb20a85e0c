"""Neighbourhood graphs: one per zone, as node and edge tables keyed by zone.

``nodes`` is (zone, idx, device_id, x, y); idx counts a zone's meters from 0 by device id. ``edges`` is
(zone, src, dst, dist, weight), both directions. Zones never share an edge, so the zone is the key of
every operator here, and zones run in parallel.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InsufficientMeters, InvalidAdjacency, InvalidGraphConfig, ZeroDegreeNode
from ..functions.geo import project
from ..storage import materialize
from .components import connected_components


@dataclass(frozen=True)
class GraphConfig:
    strategy: str = "knn_union"
    k: int = 4
    radius: float | None = None
    weights: str = "binary"
    sigma: float | None = None

    def __post_init__(self):
        if self.strategy not in ("knn_union", "knn_mutual", "radius"):
            raise InvalidGraphConfig(f"unknown strategy {self.strategy}")
        if self.weights not in ("binary", "gaussian"):
            raise InvalidGraphConfig(f"unknown weights {self.weights}")
        if self.strategy != "radius" and self.k < 1:
            raise InvalidGraphConfig("k is at least 1")
        if self.strategy == "radius" and not (self.radius and self.radius > 0):
            raise InvalidGraphConfig("a radius graph needs a positive radius")
        if self.sigma is not None and (self.weights != "gaussian" or self.sigma <= 0):
            raise InvalidGraphConfig("sigma is positive, and only for gaussian weights")


def nodes(meters: DataFrame) -> DataFrame:
    """Projected meters with their place in the zone's order."""
    order = Window.partitionBy("zone").orderBy("device_id")
    return project(meters).select("zone", (F.row_number().over(order) - 1).cast("long").alias("idx"), "device_id", "x", "y")


def pairs(points: DataFrame) -> DataFrame:
    """(zone, src, dst, dist) of all ordered pairs within a zone; an equi-join on the zone."""
    a, b = points.alias("a"), points.alias("b")
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    return a.join(b, (F.col("a.zone") == F.col("b.zone")) & (F.col("a.idx") != F.col("b.idx"))).select(
        F.col("a.zone").alias("zone"), F.col("a.idx").alias("src"), F.col("b.idx").alias("dst"), F.sqrt(dx * dx + dy * dy).alias("dist")
    )


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Pairs at most ``radius`` apart, met by grid cell: for zones too large for all of their pairs.

    Each point is sent to the cell of its own and its eight neighbours, so work follows local density.
    """
    cx, cy = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    home = points.withColumns({"cx": cx, "cy": cy})
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    away = home.withColumn("s", F.explode(moves)).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")})
    a, b = away.alias("a"), home.alias("b")
    on = (F.col("a.zone") == F.col("b.zone")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.idx") != F.col("b.idx"))
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    found = a.join(b, on).select(F.col("a.zone").alias("zone"), F.col("a.idx").alias("src"), F.col("b.idx").alias("dst"), F.sqrt(dx * dx + dy * dy).alias("dist"))
    return found.where(F.col("dist") <= radius)


def steps(dist: str, digits: int = 9) -> Column:
    """Lengths in whole units of the last of ``digits`` decimals, by one product: SQL rounds so, ``F.round`` by decimal digits."""
    return F.round(F.col(dist) * 10.0**digits)


def nearest_in_rings(points: DataFrame, k: int, digits: int = 9) -> tuple[DataFrame, int]:
    """((zone, src, dst, dist) of each node's ``k`` nearest, all if fewer, ties (to ``digits`` decimals) to the lower index; the number of pairs examined).

    A grid per zone with about 2k nodes a cell, all in one cell in small zones. Nodes look into their own cell and those within one, two, four, ...
    cells around it, and stop once the k-th distance is less than the border of what they have seen is away, or all of the zone is
    seen. Only nodes that haven't stopped go on, so work follows local density.
    """
    box = points.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)))
    cells = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("n") / (2.0 * k)))).cast("long")
    span = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(1e-9))
    box = box.select("zone", "min_x", "min_y", cells.alias("cells"), (span / cells).alias("side"))
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"min_{c}")) / F.col("side")).cast("long"), F.col("cells") - 1)
    home = materialize(points.join(box, "zone").select("zone", "idx", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"), "cells", "side"), "grid")
    other = home.select("zone", "cx", "cy", F.col("idx").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    open_, found, reach, examined = home, [], 1, 0
    while True:
        near = lambda c: F.sequence(F.greatest(F.col(c) - reach, F.lit(0)), F.least(F.col(c) + reach, F.col("cells") - 1))  # noqa: B023, E731
        looks = open_.withColumn("cx", F.explode(near("cx"))).withColumn("cy", F.explode(near("cy")))
        dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
        seen = looks.join(other, ["zone", "cx", "cy"]).where("idx <> dst").select("zone", F.col("idx").alias("src"), "dst", F.sqrt(dx * dx + dy * dy).alias("dist"))
        order = Window.partitionBy("zone", "src").orderBy(steps("dist", digits), "dst")
        ranked = seen.withColumns({"place": F.row_number().over(order), "met": F.count(F.lit(1)).over(Window.partitionBy("zone", "src"))}).where(F.col("place") <= k)
        best = materialize(ranked, "nearest")
        examined += best.where("place = 1").agg(F.sum("met")).first()[0] or 0
        last = best.groupBy("zone", F.col("src").alias("idx")).agg(F.max("place").alias("got"), F.max("dist").alias("kth"))
        judged = open_.join(last, ["zone", "idx"], "left")
        whole = (F.col("cells") <= reach + 1) | ((F.col("got") == k) & (F.col("kth") < F.col("side") * reach - 2 * 10.0**-min(digits, 6)))
        left = judged.where(~F.coalesce(whole, F.lit(False)))
        if left.isEmpty():
            found.append(best)
            break
        left = materialize(left.select(*home.columns), "grid")
        found.append(best.join(left.select("zone", F.col("idx").alias("src")), ["zone", "src"], "left_anti"))
        open_, reach = left, reach * 2
    every = functools.reduce(DataFrame.unionByName, found)
    return every.select("zone", "src", "dst", "dist"), examined


def nearest(all_pairs: DataFrame, k: int) -> DataFrame:
    """Each node's ``k`` nearest (all, if fewer), ties to the lower index."""
    order = Window.partitionBy("zone", "src").orderBy(steps("dist"), "dst")
    return all_pairs.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")


def symmetric(chosen: DataFrame, mutual: bool = False) -> DataFrame:
    """chosen united with its transpose, or intersected with it."""
    turned = chosen.select("zone", F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    return chosen.intersect(turned) if mutual else chosen.union(turned).distinct()


def edges(points: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """(zone, src, dst, dist, weight) by the configured strategy and weights."""
    if config.strategy == "radius":
        found = near_pairs(points, config.radius)
    else:
        found = symmetric(nearest_in_rings(points, config.k)[0], config.strategy == "knn_mutual")
    return weigh(found, config)


def median_lengths(found: DataFrame) -> DataFrame:
    """(zone, sigma): the median length of each zone's undirected edges."""
    return found.where("src < dst").groupBy("zone").agg(F.expr("percentile(dist, 0.5)").alias("sigma"))


def weigh(found: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    if config.weights == "binary":
        return found.withColumn("weight", F.lit(1.0))
    rows = found.withColumn("sigma", F.lit(config.sigma)) if config.sigma else found.join(median_lengths(found), "zone")
    return rows.withColumn("weight", F.exp(-(F.col("dist") * F.col("dist")) / (2 * F.col("sigma") * F.col("sigma")))).drop("sigma")


def degrees(links: DataFrame) -> DataFrame:
    return links.groupBy("zone", F.col("src").alias("idx")).agg(F.sum("weight").alias("degree"))


def isolated(points: DataFrame, links: DataFrame) -> DataFrame:
    return points.join(links.select("zone", F.col("src").alias("idx")).distinct(), ["zone", "idx"], "left_anti")


def invalid_edges(links: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Edges that no adjacency may have, with a reason: self-loops, negative weights, weights that differ by direction."""
    back = links.select("zone", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("__back"))
    both = links.join(back, ["zone", "src", "dst"], "left")
    reason = (
        F.when(F.col("src") == F.col("dst"), "self_loop")
        .when(F.col("weight") < 0, "negative")
        .when(F.col("__back").isNull() | (F.abs(F.col("weight") - F.col("__back")) > tolerance), "asymmetric")
    )
    return both.withColumn("reason", reason).where("reason is not null").drop("__back")


def build(meters: DataFrame, config: GraphConfig = GraphConfig()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all zones; a bad zone fails the whole build."""
    points = nodes(meters)
    if bad := points.groupBy("zone").count().where("count < 2").take(1):
        raise InsufficientMeters(f"zone {bad[0]['zone']} has one meter")
    links = edges(points, config)
    if bad := isolated(points, links).take(1):
        raise ZeroDegreeNode(f"meter {bad[0]['device_id']} has no neighbour")
    if bad := invalid_edges(links).take(1):
        raise InvalidAdjacency(str(bad[0]))
    return points, links


def k_hop(links: DataFrame, points: DataFrame, depth: int) -> DataFrame:
    """(zone, centre, idx): the nodes within ``depth`` hops of each node, itself included; unrolled joins."""
    reached = points.select("zone", F.col("idx").alias("centre"), "idx")
    step = links.select("zone", F.col("src").alias("idx"), F.col("dst").alias("__to"))
    for _ in range(depth):
        more = reached.join(step, ["zone", "idx"]).select("zone", "centre", F.col("__to").alias("idx"))
        reached = reached.union(more).distinct()
    return reached


def balls(links: DataFrame, points: DataFrame, radii: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(zone, radius, centre, size, members array): different k-hop balls that leave a complement.

    Of equal balls the one of the smallest radius, then centre, is kept.
    """
    size = points.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    parts = [k_hop(links, points, r).withColumn("radius", F.lit(r)) for r in sorted(set(radii))]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    made = every.groupBy("zone", "radius", "centre").agg(F.array_sort(F.collect_list("idx")).alias("members"))
    kept = made.groupBy("zone", "members").agg(F.min(F.struct("radius", "centre")).alias("k"))
    return kept.join(size, "zone").where(F.size("members") < F.col("n")).select("zone", "k.radius", "k.centre", F.size("members").cast("long").alias("size"), "n", "members")


def components(links: DataFrame, points: DataFrame) -> DataFrame:
    """(zone, idx, component): components numbered from 0 by their lowest node, of zones of any size.

    Nodes without links are components of their own.
    """
    node = lambda c: F.struct("zone", F.col(c).cast("long").alias("idx"))
    found = connected_components(links.select(node("src").alias("a"), node("dst").alias("b"))).select("node.zone", "node.idx", F.col("root.idx").alias("root"))
    rows = points.select("zone", F.col("idx").cast("long").alias("idx")).join(found, ["zone", "idx"], "left").withColumn("root", F.coalesce("root", "idx"))
    order = Window.partitionBy("zone").orderBy("root")
    numbers = rows.select("zone", "root").distinct().withColumn("component", (F.row_number().over(order) - 1).cast("long"))
    return rows.join(numbers, ["zone", "root"]).select("zone", "idx", "component")


def boundary(links: DataFrame, members: DataFrame) -> DataFrame:
    """(zone, nodes, cut): undirected edges that leave each zone's node set (zone, idx)."""
    inside = members.select("zone", F.col("idx").alias("src"))
    leaving = links.join(inside, ["zone", "src"], "left_semi").join(members.select("zone", F.col("idx").alias("dst")), ["zone", "dst"], "left_anti")
    count = members.groupBy("zone").agg(F.count(F.lit(1)).alias("nodes"))
    cut = leaving.groupBy("zone").agg(F.count(F.lit(1)).alias("cut"))
    return count.join(cut, "zone", "left").select("zone", "nodes", F.coalesce("cut", F.lit(0)).alias("cut"))


def stats(points: DataFrame, links: DataFrame) -> DataFrame:
    """One row per zone: meters, undirected edges, degree range and mean, longest edge, components, isolated meters."""
    deg = points.join(degrees(links), ["zone", "idx"], "left").fillna(0.0, ["degree"])
    by_zone = deg.groupBy("zone").agg(F.count(F.lit(1)).alias("n_meters"), F.min("degree").alias("degree_min"), F.max("degree").alias("degree_max"), F.avg("degree").alias("degree_mean"))
    lines = links.where("src < dst").groupBy("zone").agg(F.count(F.lit(1)).alias("n_edges"), F.max("dist").alias("longest"))
    parts = components(links, points).groupBy("zone", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("zone").agg(F.count(F.lit(1)).alias("components"), F.count_if(F.col("size") == 1).alias("isolated"))
    return by_zone.join(lines, "zone", "left").fillna(0, ["n_edges"]).join(parts, "zone")
