"""Operators on small inputs with known results."""

import json
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampgraph import jobs
from ampgraph.errors import IncompleteSignal, InvalidSpec, SourceError, UnknownDevice
from ampgraph.operators import detect, evaluate, experiments, graph, inject, spectral, windows
from ampgraph.sources import sinks, tables
from ampgraph.streaming import metrics


@pytest.fixture(scope="module")
def network(spark):
    points = spark.createDataFrame([(z, i, f"dev-{z}{i}", 0.0, 0.0) for z in ("a", "b") for i in range(6)], "zone string, idx long, device_id string, x double, y double")
    pairs = [(i, i + 1) for i in range(5)]
    links = spark.createDataFrame([(z, s, t, 1.0, 1.0) for z in ("a", "b") for p in pairs for s, t in (p, p[::-1])], "zone string, src long, dst long, dist double, weight double")
    return points, links


def test_fraction_events_fold_in_order(spark):
    x = spark.createDataFrame([("a", t, i, 10.0) for t in range(4) for i in range(3)], "zone string, t long, idx long, value double")
    groups = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 2, 1)], "zone string, event int, idx long")
    events = spark.createDataFrame([("a", 1, 1, 2, 0.5, 1), ("a", 2, 2, 2, 0.1, -1)], "zone string, event int, start int, duration int, fraction double, direction int")
    got = {(r.t, r.idx): (round(r.value, 9), r.truth) for r in inject.inject_in_order(x, groups, events).collect()}
    assert got[1, 0] == (15.0, True) and got[1, 1] == (15.0, True) and got[2, 1] == (13.5, True) and got[3, 1] == (9.0, True)
    assert got[3, 0] == (10.0, False) and got[0, 1] == (10.0, False) and len(got) == 12


def test_signals_with_gaps_raise(spark, network):
    points, links = network
    x = spark.createDataFrame([("a", t, i, float(i)) for t in range(3) for i in range(6) if (t, i) != (1, 4)], "zone string, t long, idx long, value double")
    with pytest.raises(Exception, match="node 4 has no finite value at 1"):
        spectral.diffuse(links, x).collect()
    whole = spectral.complete(x, points)
    assert {r.t for r in whole.collect()} == {0, 2} and spectral.diffuse(links, whole).count() == 12
    assert issubclass(IncompleteSignal, ValueError)


def test_a_trailing_node_without_links_counts(spark, network):
    _, links = network
    x = spark.createDataFrame([("a", 0, i, float(i)) for i in range(7)], "zone string, t long, idx long, value double")
    got = {r.idx: r.value for r in spectral.diffuse(links, x).collect()}
    assert len(got) == 7 and abs(got[6] - 6.0) < 1e-9


def test_blocks_of_instants_change_nothing(spark, network, monkeypatch):
    _, links = network
    rng = np.random.default_rng(1)
    x = spark.createDataFrame([("a", t, i, float(rng.normal())) for t in range(9) for i in range(6)], "zone string, t long, idx long, value double")
    want = sorted(map(tuple, spectral.diffuse(links, x).collect()))
    sweep = sorted(map(tuple, spectral.tau_sweep(links, x, (0.5, 1.0)).collect()))
    monkeypatch.setattr(spectral, "BLOCK", 2)
    assert np.allclose([r[3] for r in sorted(map(tuple, spectral.diffuse(links, x).collect()))], [r[3] for r in want])
    assert np.allclose([r[2] for r in sorted(map(tuple, spectral.tau_sweep(links, x, (0.5, 1.0)).collect()))], [r[2] for r in sweep])


def test_percentiles_and_global_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), strict=True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(900, 0, None)], "id long, g int, v double")
    for r in evaluate.percentiles(df, "v", {"low": 0.01, "mid": 0.5, "high": 0.99}, "g").collect():
        own = [v for g, v in rows if g == r.g]
        assert np.allclose([r.low, r.mid, r.high], np.quantile(own, [0.01, 0.5, 0.99]))
    got = {r.id: r.place for r in evaluate.numbered(df.where("v is not null"), "v", "id").collect()}
    assert [got[i] for _, i in sorted((v, i) for i, (_, v) in enumerate(rows))] == list(range(1, 501))
    assert evaluate.numbered(df.where("id < 0"), "v", "id").count() == 0


def test_validation_counts_false_alarms(spark, network):
    points, links = network
    balls = graph.balls(links, points, (1,))
    config = detect.DetectorConfig(window=4, step=1, samples=400)
    cuts = detect.calibrate(balls, 1.0, config, seed=3, instants=16)
    rows = detect.validate(balls, cuts, 1.0, config, instants=9000).collect()
    assert {r.windows for r in rows} == {9000 - 4 + 1} and all(0 < r.episodes <= r.fired < 200 for r in rows)
    high = detect.validate(balls, cuts.withColumn("threshold", F.lit(99.0)), 1.0, config, instants=500).collect()
    assert all(r.fired == 0 and r.episodes == 0 for r in high)


def test_statistics_separate_what_they_are_for():
    rng = np.random.default_rng(5)
    a = np.zeros((8, 8))
    for i in range(7):
        a[i, i + 1] = a[i + 1, i] = 1
    masks, own = experiments.ball_masks(a, [1]), np.zeros((300, 8), bool)
    own[:, 2:5] = True
    clean = rng.normal(0, experiments.SIGMA, (300, 16, 8))
    event = clean + own[:, None, :] * experiments.SIGMA
    down, up = (experiments.statistics(x, a, masks, own, 16) for x in (clean, event))
    auc = {n: experiments.separation(down[n], up[n])[1] for n in experiments.STATISTICS}
    assert auc["oracle"] > 0.99 and auc["scan"] > 0.95 and auc["oracle"] >= auc["threshold"]


def test_the_injection_job(spark, network, tmp_path):
    points, links = network
    spec = {"instants": 20, "sigma": 1.0, "mean": 5.0, "events": [{"start": 2, "duration": 3, "depth": 1, "sigma_multiple": 2.0, "seed_device_id": "dev-a2"}, {"start": 8, "duration": 2, "size_target": 4, "sigma_multiple": 1.0}]}
    rows, events = jobs.injected(points, links, jobs.read_spec(json.dumps(spec)))
    hit = {(r.zone, r.t, r.idx): r.value - r.base for r in rows.where("truth").collect()}
    assert {k for k in hit if k[1] < 8} == {("a", t, i) for t in (2, 3, 4) for i in (1, 2, 3)}
    assert len([k for k in hit if k[1] >= 8]) == 2 * 2 * 4 and all(abs(v - (2.0 if k[1] < 8 else 1.0)) < 1e-9 for k, v in hit.items())
    sinks.write_injection(rows, str(tmp_path / "out/signal"))
    sinks.write_injection_documents(rows, events, str(tmp_path / "out"))
    assert {r.zone: r.changed for r in spark.read.json(str(tmp_path / "out/summary")).collect()} == {"a": 9 + 8, "b": 8}
    assert spark.read.json(str(tmp_path / "out/truth")).count() == 3 and spark.read.parquet(str(tmp_path / "out/signal")).count() == 240
    truth = {(r.zone, r.event): r for r in events.collect()}
    own = truth["a", 0]
    assert (own.n_nodes, own.boundary_edges, own.zone_size, own.scaled, own.expected_detectable) == (3, 2, 6, False, True)
    assert own.delta == [[2.0] * 3] * 3 and own.node_indices == [1, 2, 3] and own.max_abs_delta == 2.0 and truth["b", 1].n_nodes == 4
    mixed = spec | {"bounds": [0.0, 9.0], "on_violation": "scale", "events": [*spec["events"], {"start": 2, "duration": 2, "depth": 1, "fraction": 0.9, "seed_device_id": "dev-a2"}]}
    rows, events = jobs.injected(points, links, jobs.read_spec(json.dumps(mixed)))
    assert rows.agg({"value": "max"}).first()[0] == pytest.approx(9.0)
    last = events.where("event = 2").first()
    assert last.scaled and 0 < last.fraction < 0.9 and last.fraction == pytest.approx(0.9 * last.scale)
    for bad, error in (({"events": []}, InvalidSpec), (spec | {"instants": 9}, InvalidSpec)):
        with pytest.raises(error):
            jobs.read_spec(json.dumps(bad))
    with pytest.raises(UnknownDevice):
        jobs.injected(points, links, jobs.read_spec(json.dumps(spec | {"events": [spec["events"][0] | {"seed_device_id": "nobody"}]})))


def test_the_guard_survives_an_unreadable_registry(spark):
    armed = spark.createDataFrame([("a", "x")], "zone string, fingerprint string")
    seen = []
    run = metrics.topology_guard(armed, lambda: spark.read.parquet("/nowhere/at/all"), lambda b, i: seen.append(i))
    run(armed, 7)
    assert seen == [7]


def test_rest_reads(spark, tmp_path):
    import functools
    import http.server
    import threading

    (tmp_path / "ok").write_text(json.dumps([{"reading_id": 1, "meter_id": "m", "event_time": "2026-01-01T00:00:00Z"}, {"reading_id": 2, "event_time": "soon"}]))
    handler = functools.partial(type("Quiet", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *a: None}), directory=str(tmp_path))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    rows = {r.reading_id: r for r in tables.read_records(spark, f"{url}/ok").collect()}
    assert rows[1].event_time is not None and rows[2].event_time is None
    assert tables.read_records(spark, f"{url}/nothing") is None
    server.shutdown()
    server.server_close()
    with pytest.raises(SourceError):
        tables.read_records(spark, url, timeout_s=1)


def test_percentiles_of_many_groups_are_exact(spark):
    rng = np.random.default_rng(9)
    groups = {None: rng.normal(size=50), "one": np.array([3.0]), "ties": rng.integers(0, 3, 4000).astype(float), "wide": rng.lognormal(0, 3, 60_000), "two": np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("wide", None), ("none", None)], "g string, v double")
    asked = {"least": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p999": 0.999, "most": 1.0}
    got = {r.g: r for r in evaluate.percentiles(rows, "v", asked, "g").collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert [got[g][n] for n in asked] == pytest.approx([float(np.quantile(x, q)) for q in asked.values()], rel=1e-12), g
    whole = evaluate.percentiles(rows, "v", asked).first()
    everything = np.concatenate(list(groups.values()))
    assert [whole[n] for n in asked] == pytest.approx([float(np.quantile(everything, q)) for q in asked.values()], rel=1e-12)
    assert evaluate.percentiles(rows.where("false"), "v", asked, "g").collect() == []


def test_the_guard_rereads_by_its_interval(spark):
    armed, reads, seen, now = spark.createDataFrame([("z", "1")], "zone string, fingerprint string"), [], [], [0.0]

    def live():
        reads.append(now[0])
        return armed

    results = Counter()
    run = metrics.topology_guard(armed, live, lambda b, i: seen.append(i), every_s=300, clock=lambda: now[0], results=results)
    for i, t in enumerate((0.0, 10.0, 299.0, 300.0, 301.0)):
        now[0] = t
        run(armed, i)
    assert reads == [0.0, 300.0] and seen == [0, 1, 2, 3, 4] and results == {"equal": 2}
    totals = metrics.Totals()
    totals.onQueryStarted(None)
    totals.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(observedMetrics={}, numInputRows=7, batchDuration=1500)))
    assert totals.series() == {"cycle_seconds": 1.5, "cycles": 1, "failed_publications": 0, "connected": 1.0}
    totals.onQueryTerminated(SimpleNamespace(exception="ampgraph.errors.PublishError: a row has no topic"))
    assert totals.series()["failed_publications"] == 1 and totals.series()["connected"] == 0.0


def test_width_choice_and_fit(spark):
    report = spark.createDataFrame([(w, z, s) for w, by in ((5, (0.2, 0.9)), (6, (0.96, 0.99)), (10, (1.0, 1.0))) for z, s in zip("ab", by, strict=True)], "width long, zone string, window_share double")
    assert tuple(windows.choose_width(report, 16).first()) == (6, "target", 0.96, 96, "a")
    assert tuple(windows.choose_width(report.where("width = 5"), 16).first())[:3] == (5, "best", 0.2)
    assert windows.choose_width(report.where("false"), 16).collect() == []
    fits = windows.check_fit(spark.createDataFrame([("a", 16), ("b", 8)], "zone string, window int"), spark.createDataFrame([(z, 16) for z in "abc"], "zone string, length int"))
    assert {r.zone: r.fits for r in fits.collect()} == {"a": True, "b": False, "c": False}
