"""How work is laid out over tasks, and that shared steps give what plain ones give."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampgraph.operators import experiments, readings, registry


def ring(n):
    a = np.zeros((n, n))
    for i in range(n):
        a[i, (i + 1) % n] = a[(i + 1) % n, i] = 1
    a[0, n // 2] = a[n // 2, 0] = 1
    return a


@pytest.fixture(scope="module")
def zones(spark):
    a = ring(9)
    links = [(f"z{z}", int(i), int(j), 1.0, 1.0) for z in range(40) for i, j in np.argwhere(a > 0)]
    return spark.createDataFrame(links, "zone string, src long, dst long, dist double, weight double")


@pytest.mark.parametrize("over", [{}, {"length": 40, "aligned": False, "size": 3}, {"length": 40, "aligned": False, "size": 4, "shape": "extended"}, {"tau": 0.5, "window": 4, "length": 9}])
def test_trials_are_those_of_whole_signals(over):
    """Rates from shared draws and shifted responses against signals with the event written into them."""
    a, seed = ring(11), 5  # no ball is another's complement, which would tie
    p = SimpleNamespace(**(experiments.BASE | {"sigma": 1.0} | over))
    trials = experiments.Trials(a, seed, {})
    trials.run(SimpleNamespace(**{**vars(p), "aligned": not p.aligned}))  # what is kept for other sets is not taken for this
    got = trials.run(p)
    n, w, s = len(a), p.window, experiments.SIGMA
    rng = np.random.default_rng([seed, w, int(p.sigma * 100), p.length])
    masks, groups = experiments.ball_masks(a, p.radii), trials.groups(p)
    smooth = trials.smooth(p.tau) if p.tau else np.eye(n)

    def contrasts(x):
        means = np.stack([x[:, i : i + w].mean(1) for i in range(p.length - w + 1)], 1) @ smooth
        k = masks.sum(1)
        inside = means @ masks.T
        return np.abs(inside / k - (means.sum(2, keepdims=True) - inside) / (n - k)) / (s / np.sqrt(w) * np.sqrt(1 / k + 1 / (n - k)))

    cut = np.quantile(contrasts(rng.normal(0, s, (experiments.CALIBRATION, p.length, n))).max((1, 2)), 1 - experiments.FPR)
    clean = rng.normal(experiments.MEAN, s, (p.trials, p.length, n)) - experiments.MEAN
    starts = np.zeros(p.trials, int) if p.aligned else rng.integers(0, p.length - w + 1, p.trials)
    event = clean.copy()
    for i, at in enumerate(starts):
        event[i, at : at + w, groups[i % n]] += p.sigma * s
    at = np.arange(p.length - w + 1)
    fired = (contrasts(event).max(2) > cut) & (at < (starts + w)[:, None]) & (at + w > starts[:, None])
    tp = fp = fn = 0
    for i in np.flatnonzero(fired.any(1)):
        marked, truth = masks[contrasts(event)[i, fired[i]].argmax(1)].any(0), groups[i % n]
        tp, fp, fn = tp + (marked & truth).sum(), fp + (marked & ~truth).sum(), fn + (~marked & truth).sum()
    assert got["scan_rate"] == fired.any(1).mean() and got["scan_fpr"] == (contrasts(clean).max((1, 2)) > cut).mean()
    assert got["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn)) and 0 < tp
    assert got["auc"] == pytest.approx(experiments.separation(contrasts(clean).max((1, 2)), contrasts(event).max((1, 2)))[1])


def test_experiments_of_few_bytes_go_to_many_tasks(spark, zones):
    """el_group_size and its kin: adaptive plans merged small partitions, and one task tried all zones."""
    sets = experiments.grid(spark, trials=[20])
    rows = experiments.run(zones, sets).withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() > 8


def added_in_order(spark, *bins):
    rows = [("z", b, v) for b, values in enumerate(bins) for v in values]
    return readings.curve(spark.createDataFrame(rows, "zone string, bin long, value double").coalesce(1))


def test_a_mean_at_the_mark_is_not_above_it_in_any_order(spark):
    """win_episode_edges: the mean of these is 50, and 50.00000000000001 if they are added up in this order."""
    values = (22.01, 93.25, 41.79, 10.33, 82.62)
    y = added_in_order(spark, values, values[::-1])
    assert not readings.edges_of_episodes(y.select("zone", "bin", (F.col("y") > 50).alias("above"))).where("rise").count()


def test_equal_means_are_no_extremum_in_any_order(spark):
    """win_local_extrema: three equal means, of which the middle one is added up in another order."""
    values = (22.01, 93.25, 41.79, 10.33, 82.62)
    assert not readings.extrema(added_in_order(spark, values[::-1], values, values[::-1])).count()


def test_pairs_of_zones_in_blocks(spark):
    """jn_zone_pairs: no join by order meets all meters of all zones; blocks of zones give each pair once."""
    rng = np.random.default_rng(3)
    rows = [(f"z{z}", float(x), float(y)) for z in range(23) for x, y in rng.random((1 + 40 * (z % 4), 2))]
    got = registry.zone_pairs(spark.createDataFrame(rows, "zone string, x double, y double"), block=4)
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    at = {z: np.array([r[1:] for r in rows if r[0] == z]) for z in {r[0] for r in rows}}
    want = {(a, b): (np.hypot(*(at[a].mean(0) - at[b].mean(0))), np.hypot(*(at[a][:, None] - at[b]).transpose(2, 0, 1)).min()) for a in at for b in at if a < b}
    found = got.collect()
    assert len(found) == len(want) and all(want[r.za, r.zb] == pytest.approx((r.centroids, r.nearest)) for r in found)


def test_calibration_goes_to_many_tasks_and_draws_once_in_each(spark, zones):
    """dt_calibrate_all: all zones were one task's, and each drew the same signals again."""
    points = zones.select("zone", F.col("src").alias("idx")).distinct()
    from ampgraph.operators import detect, graph

    balls = graph.balls(zones, points, (1, 2))
    config = detect.DetectorConfig(samples=100, step=1)
    cuts = detect.calibrate(balls, 1.0, config, seed=3, instants=20)
    assert cuts.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 8
    found = {r.threshold for r in cuts.collect()}
    masks = experiments.ball_masks(ring(9), (1, 2))
    one = float(np.quantile(detect.null_maxima(masks, 1.0, config, 3, 20), 0.99))
    assert len(found) == 1 and found.pop() == pytest.approx(one)
    fired = detect.validate(balls, cuts, 1.0, config, instants=5000).collect()
    assert len(fired) == 40 and len({(r.windows, r.fired, r.episodes) for r in fired}) == 1 and fired[0].windows == 5000 - 15


def test_one_zone_replays_its_own_line(spark, monkeypatch):
    """st_run_zone: the replay gets one zone's devices and ticks, and the rows of all are the same there."""
    from ampgraph.plans import reports

    sf, seen, replay = "/root/testdata/sf0.01", [], reports.processor.replay
    monkeypatch.setattr(reports.processor, "replay", lambda readings, devices, clock, *rest, **more: seen.append((devices, clock)) or replay(readings, devices, clock, *rest, **more))
    one = reports.st_run_zone(spark, sf)
    assert all({r.zone for r in rows.select("zone").distinct().collect()} == {"z000000"} for rows in seen[0])
    assert sorted(map(str, one.collect())) == sorted(map(str, reports._cycles(spark, sf).where("zone = 'z000000'").collect()))


def test_kernels_by_zone_go_to_many_tasks(spark, zones):
    """sp_sign_compare: kernels over zones and blocks of instants."""
    from ampgraph.operators import spectral

    x = spark.createDataFrame([(f"z{z}", 0, i, i * 1.5) for z in range(40) for i in range(9)], "zone string, t long, idx long, value double")
    for rows in (spectral.diffuse(zones, x), spectral.spectrum(zones)):
        assert rows.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 8


def test_single_meters_are_scored_once_a_seed(monkeypatch):
    """el_mag_dur and its kin: each zone and set took the products of all windows with single meters again."""
    asked, plain = [], experiments.responses
    monkeypatch.setattr(experiments, "responses", lambda w, m: asked.append(len(w)) or plain(w, m))
    sets = [SimpleNamespace(**(experiments.BASE | {"trials": 60, "length": 20, "window": w, "aligned": False, "radii": [1]})) for w in (1, 4)]
    draws, small = {}, ring(11)
    small[0, 5] = small[5, 0] = 0
    for a in (ring(11), small):
        trials = experiments.Trials(a, 5, draws)
        balls = len(experiments.ball_masks(a, [1]))
        for p in sets:
            got, n = trials.run(p), len(a)
            _, means, starts = trials.drawn(p)
            at = np.arange(p.length - p.window + 1)
            share = np.maximum(p.window - np.abs(at - starts[:, None]), 0) / p.window
            event = means + p.sigma * experiments.SIGMA * share[:, :, None] * trials.groups(p)[np.sort(np.arange(60) % n)][:, None]
            assert got["meter_rate"] == experiments.separation(np.abs(means).max((1, 2)), np.abs(event).max((1, 2)))[0]
            own = trials.groups(p)[np.sort(np.arange(60) % n)]
            # what is scored in reach of events alone is what whole signals of the means give
            down, up = (experiments.statistics(x, a, experiments.ball_masks(a, [1]), own, 1) for x in (means, event))
            for row in got["scores"]:
                scale = 1.0 if row["statistic"] != "scan" else experiments.SIGMA
                rate, area = experiments.separation(down[row["statistic"]] / scale, up[row["statistic"]] / scale)
                assert row["rate"] == pytest.approx(rate) and row["auc"] == pytest.approx(area, abs=1e-3)
    assert asked == [balls] * 8


@pytest.mark.parametrize("trials, windows", [(30, 1), (90, 60)])
def test_strongest_response_in_narrow_and_wide_windows(trials, windows):
    rng = np.random.default_rng(1)
    seeds = np.repeat(np.sort(np.arange(trials) % 5), windows)
    clean, shift, share = rng.normal(size=(7, len(seeds))), rng.normal(size=(7, 5)), rng.random(len(seeds))
    want = np.abs(clean + shift[:, seeds] * share).max(0)
    assert np.array_equal(experiments.strongest(clean, shift, seeds, share), want)


def test_auc_ranks_clean_values_before_equal_ones():
    down, up = np.array([1.0, 2.0, 2.0, 3.0]), np.array([2.0, 3.0, 0.0])
    rank = np.r_[down, up].argsort(kind="stable").argsort()[4:] + 1
    assert experiments.auc(down, up) == (rank.sum() - 6) / 12


def test_a_zones_frame_is_the_same_in_any_order(spark):
    """gr_k_sweep: nearest neighbours tie, and the last bit of the zone's mean position, which depended on the order of rows, chose among them."""
    from ampgraph.functions.geo import local_frames

    values = (22.01, 93.25, 41.79, 10.33, 82.62)
    rows = [(z, v, -v) for z, order in (("a", values), ("b", values[::-1])) for v in order]
    a, b = local_frames(spark.createDataFrame(rows, "zone string, lat double, lon double").coalesce(1)).orderBy("zone").collect()
    assert a[1:] == b[1:] and a.lat0 == 50.0
