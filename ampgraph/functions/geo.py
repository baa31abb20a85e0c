"""Geodesy as column expressions: a local tangent frame per zone on the WGS84 ellipsoid."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the WGS84 ellipsoid: semi-major axis in metres and flattening.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def curvature_radii(lat: Column) -> tuple[Column, Column]:
    """(meridional, normal) radii of curvature in metres at a latitude in degrees."""
    s = F.sin(F.radians(lat))
    w = F.sqrt(1 - F.lit(E2) * s * s)
    return F.lit(A * (1 - E2)) / (w * w * w), F.lit(A) / w


def exact_mean(name: str) -> Column:
    """The mean of coordinates summed as decimals, so that its last bit doesn't depend on the order of rows; plain where some aren't finite."""
    exact = F.col(name).try_cast("decimal(38,18)")
    return F.when(F.count(exact) == F.count(name), F.avg(exact).cast("double")).otherwise(F.avg(name))


def local_frames(meters: DataFrame) -> DataFrame:
    """(zone, lat0, lon0, m, n): each zone's mean position and the radii there."""
    origin = meters.groupBy("zone").agg(exact_mean("lat").alias("lat0"), exact_mean("lon").alias("lon0"))
    m, n = curvature_radii(F.col("lat0"))
    return origin.withColumns({"m": m, "n": n})


def project(meters: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """``meters`` with x (east) and y (north) in metres from their zone's origin."""
    rows = meters.join(frames if frames is not None else local_frames(meters), "zone")
    x = F.col("n") * F.cos(F.radians("lat0")) * F.radians(F.col("lon") - F.col("lon0"))
    y = F.col("m") * F.radians(F.col("lat") - F.col("lat0"))
    return rows.withColumns({"x": x, "y": y}).drop("lat0", "lon0", "m", "n")


def vincenty(lat1: float, lon1: float, lat2: float, lon2: float, rounds: int = 200, tolerance: float = 1e-14) -> float:
    """Geodesic distance in metres by Vincenty's inverse formula; coincident points are 0 apart."""
    if lat1 == lat2 and lon1 == lon2:
        return 0.0
    f, b = FLATTENING, A * (1 - FLATTENING)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    long = lam = math.radians(lon2 - lon1)
    for _ in range(rounds):
        across = math.cos(u2) * math.sin(lam)
        along = math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam)
        sin_s = math.hypot(across, along)
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        s = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2a = 1 - sin_a * sin_a
        mid = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2a if cos2a else 0.0
        c = f / 16 * cos2a * (4 + f * (4 - 3 * cos2a))
        before, lam = lam, long + (1 - c) * f * sin_a * (s + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1)))
        if abs(lam - before) < tolerance:
            break
    k2 = cos2a * (A * A - b * b) / (b * b)
    p = 1 + k2 / 16384 * (4096 + k2 * (k2 * (320 - 175 * k2) - 768))
    q = k2 / 1024 * (256 + k2 * (k2 * (74 - 47 * k2) - 128))
    d = q * sin_s * (mid + q / 4 * (cos_s * (2 * mid * mid - 1) - q / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)))
    return b * p * (s - d)


@F.pandas_udf(T.DoubleType())
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series([vincenty(*x) for x in zip(lat1, lon1, lat2, lon2, strict=True)], dtype="float64")
