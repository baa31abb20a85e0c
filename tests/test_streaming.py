"""Window semantics of the live path, its batch twin, and the stateful stream itself."""

import json
import os
import random
import time
from collections import Counter
from datetime import UTC, datetime

import pytest

from ampgraph.operators import detect, graph
from ampgraph.operators.windows import WindowConfig
from ampgraph.streaming import live
from ampgraph.streaming.processor import STATE_STORE, ZoneState, emit, observe, replay, step

CONFIG = WindowConfig(bin_us=6_000_000, length=2, grace_us=1_000_000)
NAMES = ["a", "b"]
S = 1_000_000


def test_latest_event_wins_and_ties_go_to_the_first():
    z = ZoneState()
    assert observe(z, "a", 1 * S, 1.0, None, NAMES, CONFIG) == "accepted"
    assert observe(z, "a", 3 * S, 2.0, None, NAMES, CONFIG) == "accepted"
    assert observe(z, "a", 3 * S, 9.0, None, NAMES, CONFIG) == "superseded"
    assert observe(z, "a", 2 * S, 9.0, None, NAMES, CONFIG) == "superseded"
    assert z.cells[0, "a"] == (3 * S, 2.0) and z.counts["superseded"] == 3


def test_rejections():
    z = ZoneState()
    assert observe(z, "x", 0, 1.0, None, NAMES, CONFIG) == "unknown"
    assert observe(z, "a", 100 * S, 1.0, 0, NAMES, CONFIG) == "future"
    z.emitted = 3
    assert observe(z, "a", 23 * S, 1.0, None, NAMES, CONFIG) == "late"


def test_warm_up_then_window_then_gap():
    z = ZoneState()
    row = step(z, "z", [("a", 1 * S, 1.0), ("b", 2 * S, 3.0)], 7 * S, NAMES, CONFIG)[0]
    assert (row["bin"], row["reason"]) == (0, "calentamiento")
    row = step(z, "z", [("a", 7 * S, 2.0), ("b", 8 * S, 5.0)], 13 * S, NAMES, CONFIG)[0]
    assert row["status"] == "ventana" and row["means"] == [1.5, 4.0]
    row = step(z, "z", [("a", 13 * S, 2.0)], 25 * S, NAMES, CONFIG)[0]
    assert row["skipped"] == 1 and row["reason"] == "bins_incompletos" and row["missing"] == "a,b"
    assert emit(z, "z", 25 * S, NAMES, CONFIG) is None
    assert emit(ZoneState(), "z", 2 * S, NAMES, CONFIG) is None


def test_replay_of_the_same_input(spark):
    rows = [("z", i, d, t * S, float(t), t * S + 10) for i, (d, t) in enumerate([("a", 1), ("b", 2), ("a", 7), ("b", 8), ("a", 13), ("b", 14)])]
    readings = spark.createDataFrame(rows, "zone string, id long, device_id string, ts_us long, value double, arrival_us long")
    devices = spark.createDataFrame([("z", d) for d in NAMES], "zone string, device_id string")
    clock = spark.createDataFrame([("z", t * S) for t in (7, 13, 19)], "zone string, at_us long")
    got = [(r.bin, r.status, r.means) for r in replay(readings, devices, clock, CONFIG).orderBy("bin").collect()]
    assert got == [(0, "sin_datos", None), (1, "ventana", [4.0, 5.0]), (2, "ventana", [10.0, 11.0])]


@pytest.fixture
def state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def message(device, ts_s, value, **more):
    stamp = datetime.fromtimestamp(ts_s, UTC).isoformat()
    return json.dumps({"device_id": device, "timestamp_utc": stamp, "value": value, "zone": "elsewhere"} | more)


def network(spark):
    """Two zones of a path of five meters each, their plans, and ids."""
    ids = {z: [f"{z}{i}" for i in range(5)] for z in "pq"}
    points = spark.createDataFrame([(z, i, d, 0.0, 0.0) for z in ids for i, d in enumerate(ids[z])], "zone string, idx long, device_id string, x double, y double")
    links = [(z, a, b, 1.0, 1.0) for z in ids for i in range(4) for a, b in ((i, i + 1), (i + 1, i))]
    balls = graph.balls(spark.createDataFrame(links, "zone string, src long, dst long, dist double, weight double"), points, (1,))
    cuts = spark.createDataFrame([(z, 3.0, 1.0, CONFIG.length) for z in ids], "zone string, threshold double, sigma double, window int")
    return ids, points, balls, cuts


REFUSED = [("{nonsense", "json"), ("[1]", "json"), ("", "json"), (json.dumps({"device_id": "p0", "value": 1}), "field"), (message("p0", 3, None), "field"), (message("p0", 3, "much"), "value"), (message("p0", 3, "NaN"), "value"),
           (message("p0", 3, 1.0, timestamp_utc="1970-01-01T00:00:03"), "naive_time"), (message("p0", 3, 1.0, timestamp_utc="soon"), "time"), (message("nobody", 3, 1.0), "unknown")]


def test_stream_equals_replay_and_scan_over_batches_and_a_restart(spark, tmp_path, state_store):
    ids, points, balls, cuts = network(spark)
    plans = detect.plans(balls, cuts)
    rng, batches, readings, arrival = random.Random(6), [], [], 0
    for b in range(4):  # two bins a batch
        lines = []
        for t in (2 * b, 2 * b + 1):
            for z, own in ids.items():
                for i, d in enumerate(own):
                    if (z, t, i) == ("q", 3, 2):
                        continue  # a gap
                    value = rng.gauss(0, 1) + (9.0 if z == "p" and i in (1, 2, 3) and t >= 4 else 0.0)
                    lines.append((d, t * 6 + 1 + i / 10, value))
                    if i == 0:
                        lines.append((d, t * 6 + 1, 99.0))  # an equal or older reading of a cell
        if b == 2:
            lines.append(("p4", 1.0, 5.0))  # long emitted
        at = (2 * b + 2) * 6 + 2  # seconds; the batch's last message
        rows = []
        for n, (d, ts, value) in enumerate(lines):
            arrival = at * S - (len(lines) - 1 - n) * 10
            rows.append({"value": message(d, ts, value), "arrival_us": arrival})
            readings.append(("elsewhere", arrival, d, round(ts * S), value, arrival))
        rows += [{"value": bad, "arrival_us": arrival} for bad, _ in REFUSED] if b == 1 else []
        batches.append("\n".join(map(json.dumps, rows)))
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for some in (batches[:2], batches[2:]):  # the second start goes on from the checkpoint
        for text in some:
            file = source / f"{(n := batches.index(text))}.json"
            file.write_text(text)
            os.utime(file, (1e9 + n, 1e9 + n))  # files come in the order of their times
        raw = spark.readStream.schema("value string, arrival_us long").option("maxFilesPerTrigger", 1).json(str(source))
        stream = live.live(raw, points.select("device_id", "zone"), plans, CONFIG, clock="arrival")
        query = stream.writeStream.foreachBatch(live.route(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
    got = spark.read.parquet(f"{out}/windows")
    fields = ["zone", "bin", "status", "reason", "incomplete", "missing", "skipped", "detected", "radius", "centre", "size"]
    kind = "zone string, id long, device_id string, ts_us long, value double, arrival_us long"
    clock = spark.createDataFrame([(z, ((2 * b + 2) * 6 + 2) * S) for z in ids for b in range(4)], "zone string, at_us long")
    want = detect.scan(replay(spark.createDataFrame(readings, kind), points.select("zone", "device_id"), clock, CONFIG), plans)
    key = lambda rows: sorted((tuple(r[f] for f in fields) + (round(r["statistic"], 6) if r["statistic"] is not None else None,) for r in rows), key=str)
    assert key(got.where("status <> 'sin_bin'").collect()) == key(want.collect()) and got.count() == 8
    statuses = {(r.zone, r.bin): (r.status, r.detected) for r in got.collect()}
    assert statuses["p", 7] == ("ventana", True) and statuses["q", 3][0] == "sin_datos" and statuses["q", 7] == ("ventana", False)
    reasons = Counter(r.reason for r in spark.read.parquet(f"{out}/rejected").collect())
    assert reasons == Counter(r for _, r in REFUSED) + Counter(superseded=16, late=1)
    counts = {(r.series, r.zone, r.label): r.v for r in spark.read.parquet(f"{out}/series").groupBy("series", "zone", "label").agg({"value": "sum"}).withColumnRenamed("sum(value)", "v").collect()}
    assert counts["detections", "p", ""] == sum(d is True for (z, _), (_, d) in statuses.items() if z == "p") and counts["readings", "q", "accepted"] == 39
    assert counts["without_window", "q", "bins_incompletos"] == 1 and counts["readings", "p", "late"] == 1 and counts["readings", None, "unknown"] == 1
    before = got.count()
    live.route(out)(spark.createDataFrame([], stream.schema), 0)  # a repeated batch replaces its own rows alone
    assert spark.read.parquet(f"{out}/windows").count() == before - 2


def test_timers_report_zones_without_messages(spark, tmp_path, state_store):
    ids, points, balls, cuts = network(spark)
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"value": message("p0", time.time(), 1.0), "arrival_us": 1}))
    raw = spark.readStream.schema("value string, arrival_us long").json(str(source))
    rows = live.live(raw, points.select("device_id", "zone"), detect.plans(balls, cuts), WindowConfig(bin_us=6_000_000, length=2, grace_us=1_000_000), interval_ms=500)
    query = rows.writeStream.format("memory").queryName("ticks").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        seen = []
        for _ in range(60):
            time.sleep(1)
            seen = spark.sql("select zone, status, reason, expected, present from ticks").collect()
            if {r.zone for r in seen} == {"p", "q"} and len(seen) >= 4:
                break
    finally:
        query.stop()
    assert {r.zone for r in seen} == {"p", "q"} and {r.status for r in seen} <= {"sin_datos", "sin_bin"} and {r.expected for r in seen} == {5}
    assert any(r.status == "sin_bin" for r in seen) and all(r.reason == "calentamiento" for r in seen if r.status == "sin_datos" and r.zone == "q")


def test_values_that_are_no_numbers_are_refused():
    z = ZoneState()
    for bad in (None, float("nan"), float("inf")):
        assert observe(z, "a", S, bad, None, NAMES, CONFIG) == "not_finite"
    assert not z.cells and z.counts["not_finite"] == 3
