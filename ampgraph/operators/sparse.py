"""Spectra and filters of zones of any size: no matrix, only joins of edges with vectors, all zones at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidFilterParameter
from ..storage import discard, materialize
from .graph import components, degrees


def _nodes(points: DataFrame, links: DataFrame) -> DataFrame:
    """(zone, idx, root, inverse): each node's square root of degree, and its inverse (0 without neighbours)."""
    rows = points.select("zone", "idx").join(degrees(links), ["zone", "idx"], "left")
    root = F.sqrt(F.coalesce("degree", F.lit(0.0)))
    return rows.select("zone", "idx", root.alias("root"), F.when(root > 0, 1 / root).otherwise(0.0).alias("inverse"))


def _times(links: DataFrame, vectors: DataFrame, *by: str) -> DataFrame:
    """``vectors`` (zone, *by, idx, inverse, v, ...) with w = L v for the normalised Laplacian: one join and one sum over edges."""
    scaled = vectors.select("zone", *by, F.col("idx").alias("dst"), (F.col("v") * F.col("inverse")).alias("__u"))
    around = links.select("zone", "src", "dst", "weight").join(scaled, ["zone", "dst"]).groupBy("zone", *by, F.col("src").alias("idx")).agg(F.sum(F.col("weight") * F.col("__u")).alias("__a"))
    near = F.coalesce("__a", F.lit(0.0)) * F.col("inverse")
    return vectors.join(around, ["zone", *by, "idx"], "left").withColumn("w", F.when(F.col("inverse") > 0, F.col("v")).otherwise(0.0) - near).drop("__a")


def _dots(column: str, k: int) -> Column:
    """The products of a column with the first ``k`` vectors in ``qs``, as an array of sums."""
    return F.array(*(F.sum(F.col(column) * F.col("qs")[i]) for i in range(k))) if k else F.array().cast("array<double>")


def _less(column: str, coefficients: str) -> Column:
    """A column less the combination of ``qs`` with the given coefficients."""
    parts = F.zip_with("qs", coefficients, lambda q, h: q * h)
    return F.col(column) - F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def extremes(points: DataFrame, links: DataFrame, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(zone, components, largest, fiedler, error): the ends of each zone's normalised spectrum.

    Lanczos steps with the kernel deflated: one vector a component, known beforehand (square roots of degrees), so that the
    smallest value left is the smallest that isn't zero. New vectors are made orthogonal to all before them twice; each step is
    one join of edges with a vector, sums by zone, and two tables in the shared folder. Stops once all zones' estimates (the usual
    bound by the last entries of the small eigenvectors) are under ``tolerance``, or after ``steps``, which the
    largest ``error`` then tells. Zones without edges are kept, with 0 for both.
    """
    parts = components(links, points)
    nodes = materialize(_nodes(points, links).join(parts, ["zone", "idx"]), "nodes")
    mass = materialize(nodes.groupBy("zone", "component").agg(F.sum(F.col("root") * F.col("root")).alias("mass")), "mass")
    draw = F.xxhash64("zone", "idx", F.lit(17)) / F.lit(2.0**63)
    begin = nodes.withColumn("v", F.when(F.col("inverse") > 0, draw).otherwise(0.0))
    state = _unit(_deflated(begin, mass, "v"), "v", F.array().cast("array<double>"))
    state = materialize(state.drop("norm"), "lanczos")
    tri = nodes.groupBy("zone").agg(F.count_distinct("component").alias("components")).withColumns({"alphas": F.array().cast("array<double>"), "betas": F.array().cast("array<double>")})
    tri = materialize(tri, "tridiagonal")
    for j in range(1, steps + 1):
        moved = materialize(_deflated(_times(links, state), mass, "w").withColumn("qs", F.concat("qs", F.array("v"))), "lanczos")
        first = materialize(moved.groupBy("zone").agg(_dots("w", j).alias("h")), "dots")
        once = materialize(moved.join(first, "zone").withColumn("w", _less("w", "h")).drop("h"), "lanczos")
        again = once.groupBy("zone").agg(_dots("w", j).alias("h"))
        left = once.join(again, "zone").withColumn("w", _less("w", "h")).drop("h")
        after = materialize(_unit(left.drop("v"), "w", F.col("qs")), "lanczos")
        beta = after.groupBy("zone").agg(F.first("norm").alias("beta"))
        grown = tri.join(first, "zone").join(beta, "zone").select("zone", "components", F.concat("alphas", F.array(F.col("h")[j - 1])).alias("alphas"), F.concat("betas", F.array("beta")).alias("betas"))
        grown = materialize(grown, "tridiagonal")
        discard(state, moved, first, once, tri)
        state, tri = after.drop("norm"), grown
        if (j % 4 == 0 or j == steps) and not _ends(tri).where(F.col("error") > tolerance).take(1):
            break
    return _ends(tri)


def _deflated(rows: DataFrame, mass: DataFrame, column: str) -> DataFrame:
    """The column without its part in the kernel."""
    part = rows.groupBy("zone", "component").agg(F.sum(F.col(column) * F.col("root")).alias("__p")).join(mass, ["zone", "component"])
    share = part.select("zone", "component", F.when(F.col("mass") > 0, F.col("__p") / F.col("mass")).otherwise(0.0).alias("__c"))
    return rows.join(share, ["zone", "component"]).withColumn(column, F.col(column) - F.col("__c") * F.col("root")).drop("__c")


def _unit(rows: DataFrame, column: str, qs: Column) -> DataFrame:
    """The column as a unit vector ``v``, zero where nothing is left, with its norm."""
    norm = rows.groupBy("zone").agg(F.sqrt(F.sum(F.col(column) * F.col(column))).alias("__norm"))
    norm = norm.select("zone", F.when(F.col("__norm") > 1e-10, F.col("__norm")).otherwise(0.0).alias("norm"))
    v = F.when(F.col("norm") > 0, F.col(column) / F.col("norm")).otherwise(0.0)
    return rows.join(norm, "zone").select("zone", "idx", "component", "root", "inverse", v.alias("v"), qs.alias("qs"), "norm")


def _ends(tri: DataFrame) -> DataFrame:
    """Least and largest eigenvalues of each zone's small matrix, with the larger of their bounds."""

    @F.pandas_udf("largest double, fiedler double, error double")
    def solve(alphas: pd.Series, betas: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(alphas, betas, strict=True):
            k = next((i + 1 for i, x in enumerate(b) if x == 0), len(a))  # an invariant space ends it
            values, vectors = np.linalg.eigh(np.diag(a[:k]) + np.diag(b[: k - 1], 1) + np.diag(b[: k - 1], -1))
            keep = values > 1e-12
            bound = abs(b[k - 1]) * max(abs(vectors[-1, 0]), abs(vectors[-1, -1]))
            out.append((values[-1], values[keep][0], bound) if keep.any() else (0.0, 0.0, 0.0))
        return pd.DataFrame(out, columns=["largest", "fiedler", "error"])

    return tri.select("zone", "components", solve("alphas", "betas").alias("e")).select("zone", "components", "e.*")


def heat_coefficients(scale: float, tolerance: float) -> list[float]:
    """Chebyshev coefficients of exp(-scale (1 + y) / 2) on [-1, 1], so many that the rest adds up to less than the tolerance."""
    if not math.isfinite(scale) or scale <= 0:
        raise InvalidFilterParameter("the scale is finite and positive")
    at = np.cos(np.pi * (np.arange(512) + 0.5) / 512)
    values = np.exp(-scale * (1 + at) / 2)
    c = [2 / 512 * float((values * np.cos(k * np.pi * (np.arange(512) + 0.5) / 512)).sum()) for k in range(256)]
    c[0] /= 2
    rest = np.abs(c[::-1]).cumsum()[::-1]
    return c[: max(1, int((rest > tolerance).sum()))]


def diffuse(points: DataFrame, links: DataFrame, signal: DataFrame, tau: float = 0.5, tolerance: float = 1e-10, largest: DataFrame | None = None) -> DataFrame:
    """(zone, t, idx, value): the signal under exp(-λ / (τ λmax)), by a polynomial of the Laplacian.

    Chebyshev terms up to a degree whose rest is below ``tolerance``: the error of each instant is at most that times its
    norm. A term is one join of edges with the term before it and ends as a table, so lineage doesn't double.
    ``largest`` is (zone, largest), by default of ``extremes``; zones without edges stay as they are.
    """
    if not math.isfinite(tau) or tau <= 0:
        raise InvalidFilterParameter("tau is finite and positive")
    tops = (extremes(points, links) if largest is None else largest).select("zone", "largest")
    c = heat_coefficients(1 / tau, tolerance)
    rows = signal.select("zone", "t", "idx", F.col("value").cast("double").alias("v")).join(_nodes(points, links), ["zone", "idx"]).join(tops, "zone")
    now = materialize(rows.withColumns({"before": F.lit(0.0), "sum": F.lit(c[0]) * F.col("v")}), "terms")
    turned = lambda r: F.when(F.col("largest") > 0, 2 / F.col("largest") * F.col("w")).otherwise(0.0) - F.col("v")
    for k in range(1, len(c)):
        new = turned(now) if k == 1 else 2 * turned(now) - F.col("before")
        step = _times(links, now, "t").withColumn("new", new)
        after = materialize(step.select("zone", "t", "idx", "inverse", "root", "largest", F.col("v").alias("before"), F.col("new").alias("v"), (F.col("sum") + F.lit(c[k]) * F.col("new")).alias("sum")), "terms")
        discard(now)
        now = after
    return now.select("zone", "t", "idx", F.col("sum").alias("value"))
