import pytest
from pyspark.sql import functions as F

from ampgraph import errors
from ampgraph.operators.detect import DetectorConfig
from ampgraph.operators.windows import WindowConfig
from ampgraph.settings import MonitorSettings, cycle_interval, zone_filter
from ampgraph.sources import broker, sinks, tables
from ampgraph.streaming.metrics import counted, topology_guard


def test_coherence():
    MonitorSettings().check(WindowConfig(), DetectorConfig())
    for bad in ({"cycle_s": 4.0}, {"topology_check_s": 0}, {"top_k": -1}, {"topic_out": "net/readings/x"}):
        with pytest.raises(errors.SettingsError):
            MonitorSettings(**bad).check(WindowConfig(), DetectorConfig())
    with pytest.raises(errors.SettingsError):
        MonitorSettings().check(WindowConfig(length=8), DetectorConfig())
    assert MonitorSettings.from_env({"MONITOR_ZONES": " a, ,b "}).zones == ("a", "b") and zone_filter(" , ") is None


def test_cycle_interval():
    assert cycle_interval(6.0, 0.001394) == 3.0 and cycle_interval(6.0, 0.7) is None and cycle_interval(6.0, 0.2) is None


def test_guard(spark):
    armed = spark.createDataFrame([("z", "1")], "zone string, fingerprint string")
    out = []
    topology_guard(armed, lambda: armed, lambda b, i: out.append(i))(armed, 4)
    assert out == [4]
    with pytest.raises(errors.TopologyMismatch):
        topology_guard(armed, lambda: armed.withColumn("fingerprint", F.lit("2")), lambda b, i: None)(armed, 5)

    def unreachable():
        raise OSError

    topology_guard(armed, unreachable, lambda b, i: out.append(i))(armed, 6)
    assert out == [4, 6]


def test_counted_rows_pass_through(spark):
    df = spark.createDataFrame([("ventana",), ("sin_datos",)], "status string")
    assert counted(df).count() == 2


def test_records_and_files(spark, tmp_path):
    text = spark.createDataFrame([('{"reading_id": 1, "meter_id": "m", "event_time": "2026-01-01T00:00:00Z", "received_at": "x"}',)], "value string")
    r = tables.parse_records(text).first()
    assert r.event_time is not None and r.received_at is None and r.meter_id == "m"
    df = spark.createDataFrame([("z", 1, 2.0)], "zone string, t int, value double")
    sinks.write_injection(df, f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x").count() == 1
    calibration = spark.createDataFrame([("a", 4.4, 16)], "zone string, threshold double, n_meters int")
    sinks.save_calibration(calibration, f"{tmp_path}/c.json", "voltage", "f")
    assert tables.calibration_json(spark, f"{tmp_path}/c.json", "f").first().threshold == 4.4
    assert broker.BrokerSource({}).schema().startswith("topic")
