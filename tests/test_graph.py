"""Closed forms, invariants and edge cases of graphs and spectra."""

import numpy as np
import pytest

from ampgraph import errors
from ampgraph.functions.geo import vincenty
from ampgraph.operators import detect, evaluate, experiments, graph, inject, spectral, windows


def cycle(n):
    a = np.zeros((n, n))
    for i in range(n):
        a[i, (i + 1) % n] = a[(i + 1) % n, i] = 1
    return a


def frame(spark, a, zone="z"):
    rows = [(zone, int(i), int(j), 1.0, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return spark.createDataFrame(rows, "zone string, src long, dst long, dist double, weight double")


def places(spark, n, zone="z"):
    return spark.createDataFrame([(zone, i, f"d{i:02}", float(i), 0.0) for i in range(n)], "zone string, idx long, device_id string, x double, y double")


def test_closed_form_spectra():
    star = np.zeros((5, 5))
    star[0, 1:] = star[1:, 0] = 1
    assert np.allclose(np.linalg.eigvalsh(spectral.normalised(cycle(4))), [0, 1, 1, 2])
    assert np.allclose(np.linalg.eigvalsh(spectral.normalised(star)), [0, 1, 1, 1, 2])
    full = np.ones((6, 6)) - np.eye(6)
    assert np.allclose(np.linalg.eigvalsh(spectral.normalised(full)), [0] + [1.2] * 5)


def test_band_cut_never_splits_a_group():
    assert spectral.group_starts(np.array([0, 1, 1, 2.0])) == [0, 1, 3]
    assert spectral.band_cut(np.array([0, 1, 1, 2.0])) == 1
    with pytest.raises(errors.InvalidFilterParameter):
        spectral.band_cut(np.array([1.0, 1.0]))
    with pytest.raises(errors.InvalidFilterParameter):
        spectral.low_pass(np.array([0.0, 1.0]), 0)


def test_parseval_and_inverse(spark):
    a = cycle(6)
    e = frame(spark, a)
    x = spark.createDataFrame([("z", t, i, float((i * 7 + t) % 5)) for t in range(3) for i in range(6)], "zone string, t long, idx long, value double")
    back = {(r.t, r.idx): r.value for r in spectral.gft(e, spectral.gft(e, x), inverse=True).collect()}
    assert all(abs(back[r.t, r.idx] - r.value) < 1e-9 for r in x.collect())
    by_form = {r.t: r.energy for r in spectral.dirichlet(x, e).collect()}
    rows = spectral.band_energy(e, x).collect()
    for r in rows:
        assert abs(by_form[r.t] - r.rayleigh * r.total) < 1e-9


def test_diffusion_lowers_dirichlet_energy(spark):
    e = frame(spark, cycle(8))
    x = spark.createDataFrame([("z", 0, i, float(i == 3)) for i in range(8)], "zone string, t long, idx long, value double")
    before = spectral.dirichlet(x, e).first().energy
    assert spectral.dirichlet(spectral.diffuse(e, x), e).first().energy < before
    assert spectral.dirichlet(spectral.diffuse(e, x, sign=1), e).first().energy > before


def test_components_and_isolated(spark):
    a = np.zeros((5, 5))
    a[0, 2] = a[2, 0] = a[1, 3] = a[3, 1] = 1
    e, p = frame(spark, a), places(spark, 5)
    assert {r.idx: r.component for r in graph.components(e, p).collect()} == {0: 0, 2: 0, 1: 1, 3: 1, 4: 2}
    assert [r.idx for r in graph.isolated(p, e).collect()] == [4]


def test_grid_pairs_are_the_radius_join(spark):
    rng = np.random.default_rng(1)
    rows = [("z", i, f"d{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-50, 50, (60, 2)))]
    p = spark.createDataFrame(rows, "zone string, idx long, device_id string, x double, y double")
    near = {(r.src, r.dst) for r in graph.near_pairs(p, 17.0).collect()}
    assert near == {(r.src, r.dst) for r in graph.pairs(p).where("dist <= 17").collect()}


def test_balls_leave_a_complement(spark):
    b = graph.balls(frame(spark, cycle(6)), places(spark, 6), (1, 2, 3)).collect()
    assert {(r.radius, r.size) for r in b} == {(1, 3), (2, 5)} and len(b) == 12


def test_config_errors():
    for bad in ({"k": 0}, {"strategy": "radius"}, {"sigma": 1.0}, {"strategy": "other"}):
        with pytest.raises(errors.InvalidGraphConfig):
            graph.GraphConfig(**bad)
    with pytest.raises(errors.DetectorError):
        detect.DetectorConfig(samples=1)
    with pytest.raises(errors.InvalidSpec):
        inject.EventSpec("z", 0, 0, 1, depth=1, sigma_multiple=1.0, fraction=0.1)


def test_contrast_is_shift_invariant_and_finds_the_ball(spark):
    e, p = frame(spark, cycle(8)), places(spark, 8)
    b = graph.balls(e, p, (1,))
    for shift in (0.0, 100.0):
        m = spark.createDataFrame([("z", 0, i, shift + (5.0 if i in (2, 3, 4) else 0.0)) for i in range(8)], "zone string, bin long, idx long, mean double")
        best = detect.detect(detect.contrasts(m, b, 1.0, 4), 1.0).first()
        assert best.detected and best.centre == 3 and best.size == 3
    flat = spark.createDataFrame([("z", 0, i, 7.0) for i in range(8)], "zone string, bin long, idx long, mean double")
    none = detect.detect(detect.contrasts(flat, b, 1.0, 4), 1.0).first()
    assert not none.detected and none.centre is None and none.statistic < 1e-9


def test_calibrated_false_positive_rate():
    masks = experiments.ball_masks(cycle(20), (1, 2))
    config = detect.DetectorConfig(window=4, samples=2000, fpr_target=0.05)
    cut = np.quantile(detect.null_maxima(masks, 2.0, config, 1), 0.95)
    fresh = detect.null_maxima(masks, 2.0, config, 2)
    assert 0.03 < (fresh > cut).mean() < 0.07


def test_growth_is_connected_and_sized(spark):
    around = {i: [(i - 1) % 9, (i + 1) % 9] for i in range(9)}
    walked = inject.walk(around, 4, 5, np.random.default_rng(0))
    assert len(walked) == 5 and 4 in walked
    with pytest.raises(errors.InvalidSpec):
        inject.walk({0: [1], 1: [0]}, 0, 3, np.random.default_rng(0))
    links = frame(spark, cycle(9))
    wanted = "zone string, event long, seed_idx long, size long, shape string"
    for shape in ("compact", "extended"):
        rows = [("z", e, 4, size, shape) for e, size in enumerate((1, 2, 5, 9))]
        got = inject.subgraphs(links, spark.createDataFrame(rows, wanted), seed=1).collect()
        groups = {e: {r.idx for r in got if r.event == e} for e in range(4)}
        assert [len(g) for g in groups.values()] == [1, 2, 5, 9]
        for g in groups.values():
            assert 4 in g and all(any((i + s) % 9 in g for s in (1, -1)) for i in g if len(g) > 1)
            assert shape == "extended" or len(g) != 5 or g == {2, 3, 4, 5, 6}  # whole layers
    with pytest.raises(errors.InvalidSpec):
        inject.subgraphs(links, spark.createDataFrame([("z", 1, 4, 10, "compact")], wanted)).collect()


def by_hand(values, events, low, high, scale=True):
    """Events one after the other on a dictionary of cells."""
    x, did = dict(values), {}
    for number, (cells, add, part) in sorted(events.items()):
        delta = {c: add + part * x[c] for c in cells}
        room = [max(0.0, (high - x[c]) if d > 0 else (x[c] - low)) / abs(d) for c, d in delta.items() if d]
        factor = min([1.0, *room])
        assert scale or factor == 1
        for c, d in delta.items():
            x[c] += d * factor
            did[number, c] = (d * factor, factor)
    return x, did


def test_events_apply_in_order_within_bounds(spark):
    rng = np.random.default_rng(8)
    values = {(t, i): float(rng.uniform(195, 235)) for t in range(6) for i in range(5)}
    events = {}
    for n in range(1, 13):
        cells = [(t, i) for t in range(int(rng.integers(0, 5)), 6) for i in rng.choice(5, 2, replace=False).tolist()][:4]
        events[n] = (cells, float(rng.normal(0, 12)), 0.0) if n % 2 else (cells, 0.0, float(rng.normal(0, 0.1)))
    x = spark.createDataFrame([(z, t, i, v) for (t, i), v in values.items() for z in "ab"], "zone string, t long, idx long, value double")
    rows = [(z, n, t, i, add, part) for n, (cells, add, part) in events.items() for t, i in cells for z in "ab"]
    asked = spark.createDataFrame(rows, "zone string, event int, t long, idx long, add double, part double")
    for low, high in ((187.0, 253.0), (190.0, 240.0), (-1e9, 1e9)):
        want, did = by_hand(values, events, low, high)
        got, done = inject.apply_events(x, asked, low, high, "scale")
        assert {(r.zone, r.t, r.idx): round(r.value, 6) for r in got.collect()} == {(z, *c): round(v, 6) for c, v in want.items() for z in "ab"}
        assert {(r.zone, r.event, r.t, r.idx): (round(r.delta, 6), round(r.scale, 6)) for r in done.collect()} == {(z, n, *c): (round(d, 6), round(f, 6)) for (n, c), (d, f) in did.items() for z in "ab"}
    free, steps = inject.apply_events(x, asked)
    want, did = by_hand(values, events, -1e9, 1e9)
    assert {(r.zone, r.t, r.idx): round(r.value, 6) for r in free.collect()} == {(z, *c): round(v, 6) for c, v in want.items() for z in "ab"}
    assert {(r.event, r.t, r.idx): round(r.delta, 6) for r in steps.where("zone = 'a'").collect()} == {(n, *c): round(d, 6) for (n, c), (d, _) in did.items()}


def test_overlapping_events_can_leave_bounds_together(spark):
    x = spark.createDataFrame([("z", 0, 0, 230.0)], "zone string, t long, idx long, value double")
    kind = "zone string, event int, t long, idx long, add double, part double"
    for second in ((15.0, 0.0), (0.0, 0.05)):
        two = spark.createDataFrame([("z", 1, 0, 0, 15.0, 0.0), ("z", 2, 0, 0, *second)], kind)
        with pytest.raises(errors.BoundsViolation, match="event 2"):
            inject.inject(x, two, 187.0, 253.0)
        assert inject.inject(x, two, 187.0, 253.0, "scale").first().value == pytest.approx(253.0)
    with pytest.raises(errors.BoundsViolation):
        inject.inject(x, spark.createDataFrame([("z", 1, 0, 0, 0.0, 0.5)], kind), 187.0, 253.0)


def test_injection_scales_or_raises(spark):
    x = spark.createDataFrame([("z", 0, i, 10.0 + i) for i in range(4)], "zone string, t long, idx long, value double")
    change = spark.createDataFrame([("z", 1, 0, 2, 10.0), ("z", 1, 0, 3, 10.0)], "zone string, event int, t long, idx long, delta double")
    got = {r.idx: r.value for r in inject.inject(x, change, 0.0, 18.0, "scale").collect()}
    assert got == {0: 10.0, 1: 11.0, 2: 17.0, 3: 18.0}
    with pytest.raises(errors.BoundsViolation):
        inject.inject(x, change, 0.0, 18.0)


def test_rates_without_cases_are_zero(spark):
    rows = spark.createDataFrame([(False, False)], "predicted boolean, truth boolean")
    r = evaluate.confusion(rows).first()
    assert (r.tn, r.recall, r.precision, r.f1) == (1, 0.0, 0.0, 0.0)


def test_geodesic_on_the_equator_and_poles():
    assert vincenty(0, 0, 0, 0) == 0
    assert abs(vincenty(0, 0, 0, 1) - 111319.490793) < 1e-3
    assert abs(vincenty(0, 0, 90, 0) - 10001965.729) < 1e-2


def test_window_starts():
    assert windows.window_starts(10, 4) == [0, 4]
    assert windows.window_starts(10, 4, 3) == [0, 3, 6]
    assert windows.window_starts(3, 4) == []


def test_nearest_in_rings_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for z, n in (("tiny", 3), ("one", 1), ("even", 900), ("lumps", 900), ("line", 200), ("same", 12)):
        x = {"lumps": rng.integers(0, 4, (n, 2)) * 1000 + rng.normal(0, 1, (n, 2)), "line": np.c_[np.arange(n) ** 2.0, np.zeros(n)], "same": np.zeros((n, 2))}.get(z, rng.uniform(0, 1000, (n, 2)))
        x[: n // 20] = rng.uniform(-20_000, 20_000, (n // 20, 2)) if z == "lumps" else x[: n // 20]
        rows += [(z, i, f"{z}{i}", float(a), float(b)) for i, (a, b) in enumerate(x)]
    points = spark.createDataFrame(rows, "zone string, idx long, device_id string, x double, y double")
    got, _ = graph.nearest_in_rings(points, 4)
    want = graph.nearest(graph.pairs(points), 4)
    key = lambda df: sorted((r.zone, r.src, r.dst, round(r.dist, 6)) for r in df.collect())
    assert key(got) == key(want) and got.where("zone = 'one'").count() == 0
    _, examined = graph.nearest_in_rings(points.where("zone = 'even'"), 4)
    assert 900 * 4 < examined < 0.15 * 900 * 899
