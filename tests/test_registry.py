"""Validation, folds, reads, sources and sinks on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from ampgraph import errors
from ampgraph.operators import registry
from ampgraph.sources import simulator, tables
from ampgraph.sources.registry_store import RegistryStore


def test_messages(spark):
    good = {"device_id": "dev-mon-00000001", "timestamp_utc": "2026-01-01T00:00:00.000Z", "voltage": 220.0, "current": 1.0, "power": 0.2, "frequency": 60.0, "power_factor": 0.9, "extra": 1}
    cases = [(good, True), ({**good, "device_id": "x"}, False), ({**good, "timestamp_utc": "2026-01-01T00:00:00"}, False), ({k: v for k, v in good.items() if k != "power"}, False)]
    rows = [(json.dumps(m), ok) for m, ok in cases] + [("{broken", False), (None, False)]
    df = registry.parse_messages(spark.createDataFrame(rows, "value string, ok boolean").select("value"))
    got = {r.value: r.v for r in df.select("value", registry.valid_message().alias("v")).collect()}
    assert all(got[v] == ok for v, ok in rows)


def test_upsert_keeps_old_values_and_takes_the_last_arrival(spark):
    rows = [(1, "d", "mono", "z1", None, 50), (2, "d", None, "z2", "n", 40)]
    df = spark.createDataFrame(rows, "id long, device_id string, device_type string, zone string, node string, arrival_us long")
    r = registry.upsert(df).first()
    assert (r.device_type, r.zone, r.node, r.last_seen_us, r.active) == ("mono", "z2", "n", 40, True)
    merged = registry.merge(registry.upsert(df), registry.upsert(df.where("id = 1"))).first()
    assert merged.zone == "z1" and merged.node == "n" and merged.last_seen_us == 50


def test_load_meters(spark):
    rows = [("a", "z", 1.0, 1.0, None), ("b", "z", 1.0, 1.0, False), ("c", "y", None, 1.0, True)]
    df = spark.createDataFrame(rows, "device_id string, zone string, lat double, lon double, active boolean")
    assert [r.device_id for r in tables.load_meters(df, skip_incomplete=True).collect()] == ["a"]
    with pytest.raises(errors.IncompleteMeter):
        tables.load_meters(df)
    with pytest.raises(errors.NoMetersFound):
        tables.load_meters(df, zones=["none"])


def test_calibration_errors(spark):
    text = lambda d: spark.createDataFrame([(json.dumps(d),)], "value string")
    with pytest.raises(errors.CalibrationError):
        tables.parse_calibration(text({"format": "other"}), "f")
    with pytest.raises(errors.CalibrationError):
        tables.parse_calibration(text({"format": "f", "zones": {"a": {"zone": "a", "threshold": -1}}}), "f")


def test_ingest_batches_are_idempotent(spark, tmp_path):
    rows = [(1, "d", "mono", "z1", "n", 50)]
    df = spark.createDataFrame(rows, "id long, device_id string, device_type string, zone string, node string, arrival_us long")
    store = RegistryStore(spark, str(tmp_path / "store"), buckets=4)
    for _ in range(2):
        store.write(df, 0)
    store.write(df.withColumn("arrival_us", F.lit(60).cast("long")), 1)
    schema = "id long, device_id string, device_type string, zone string, node string, arrival_us long"
    assert store.readings(schema).count() == 2
    assert store.registry().first().last_seen_us == 60


def test_simulator_is_seeded_and_clamped(spark):
    a, b = (simulator.simulate(spark, 5, 300, 60, seed=3).orderBy("device_id", "ts").collect() for _ in range(2))
    assert a == b and all(187 <= r.voltage <= 253 and 0 <= r.current <= 60 for r in a)


def test_tones(spark):
    rows = spark.createDataFrame([("activo",), ("mantenimiento",), (None,), ("falla",)], "s string")
    assert [r.t for r in rows.select(registry.tone(F.col("s")).alias("t")).collect()] == ["success", "warning", "neutral", "danger"]
