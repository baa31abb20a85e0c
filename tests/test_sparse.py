"""Extremes of spectra and diffusion on edge tables, against closed forms and dense kernels."""

import math

import numpy as np
import pytest

from ampgraph.errors import InvalidFilterParameter
from ampgraph.operators import graph, sparse, spectral

LINKS = "zone string, src long, dst long, dist double, weight double"


@pytest.fixture(scope="module")
def zones(spark):
    """Closed forms: a cycle, a path, a complete graph, a star; two parts with an isolated node; a zone without edges."""
    lines = {"cycle": [(i, (i + 1) % 9) for i in range(9)], "path": [(i, i + 1) for i in range(6)], "complete": [(i, j) for i in range(5) for j in range(i)], "star": [(0, i) for i in range(1, 7)], "parts": [(0, 1), (1, 2), (3, 4), (4, 5), (5, 3)], "bare": []}
    sizes = {"cycle": 9, "path": 7, "complete": 5, "star": 7, "parts": 7, "bare": 3}
    weight = {"parts": 0.5}
    links = [(z, s, d, 1.0, weight.get(z, 1.0)) for z, pairs in lines.items() for a, b in pairs for s, d in ((a, b), (b, a))]
    points = spark.createDataFrame([(z, i) for z, n in sizes.items() for i in range(n)], "zone string, idx long")
    return points, spark.createDataFrame(links, LINKS)


@pytest.fixture(scope="module")
def tops(zones):
    return sparse.extremes(*zones, steps=12)


def test_extremes_of_closed_forms(tops):
    got = {r.zone: r for r in tops.collect()}
    want = {"cycle": (1 - math.cos(8 * math.pi / 9), 1 - math.cos(2 * math.pi / 9)), "path": (2.0, 1 - math.cos(math.pi / 6)), "complete": (1.25, 1.25), "star": (2.0, 1.0), "parts": (2.0, 1.0), "bare": (0.0, 0.0)}
    for z, (largest, fiedler) in want.items():
        assert got[z].largest == pytest.approx(largest, abs=1e-9) and got[z].fiedler == pytest.approx(fiedler, abs=1e-9), z
        assert got[z].error < 1e-9
    assert {z: r.components for z, r in got.items()} == {"cycle": 1, "path": 1, "complete": 1, "star": 1, "parts": 3, "bare": 3}


def test_diffusion_equals_the_kernel(spark, zones, tops):
    points, links = zones
    rng = np.random.default_rng(2)
    x = spark.createDataFrame([(r.zone, t, r.idx, float(rng.normal())) for r in points.collect() for t in range(3)], "zone string, t long, idx long, value double")
    whole = x.where("zone in ('cycle', 'path', 'parts')")
    for tau in (0.5,):
        got = {(r.zone, r.t, r.idx): r.value for r in sparse.diffuse(points, links, x, tau, largest=tops).collect()}
        dense = {(r.zone, r.t, r.idx): r.value for r in spectral.diffuse(links, whole, tau).collect()}
        assert len(got) == points.count() * 3
        assert max(abs(got[k] - v) for k, v in dense.items()) < 1e-8
        same = {(r.zone, r.t, r.idx): r.value for r in x.where("zone = 'bare'").collect()}
        assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in same.items())
    for bad in (0.0, -1.0, math.inf, math.nan):
        with pytest.raises(InvalidFilterParameter):
            sparse.diffuse(points, links, x, bad)


def test_coefficients_reach_the_stated_error():
    y = np.linspace(-1, 1, 401)
    for scale in (0.1, 2.0, 20.0):
        c = sparse.heat_coefficients(scale, 1e-10)
        assert np.abs(np.polynomial.chebyshev.chebval(y, c) - np.exp(-scale * (1 + y) / 2)).max() < 2e-10 and len(c) < 60


def test_components_of_a_large_zone(spark):
    """One zone of a hundred thousand nodes: chains of a thousand, and nodes alone."""
    n = 100_000
    points = spark.range(n + 10).select(F_lit("z"), "id").toDF("zone", "idx")
    chain = spark.range(n).where("id % 1000 <> 999").selectExpr("'z' as zone", "id as src", "id + 1 as dst")
    found = graph.components(chain, points)
    sizes = found.groupBy("component").count().groupBy("count").count().toDF("size", "n").collect()
    assert {r["size"]: r["n"] for r in sizes} == {1000: 100, 1: 10}
    assert found.where("component <> least(floor(idx / 1000), 100) + greatest(0, idx - 100000)").count() == 0


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)
