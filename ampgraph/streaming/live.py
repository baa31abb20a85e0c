"""The live path whole: messages in; windows with their detections, reasons for none, and rejected messages out.

Messages take their zone from the registry before the state, never from themselves. The state is keyed by zone and starts
from the registry, so zones without messages report too. What comes out of it meets the zones' balls and thresholds
in a stream-static join, all in one query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import detect
from ..operators.registry import finite
from ..operators.windows import WindowConfig
from .processor import COUNTERS, SLACK, ZoneState, emit, observe

#: A row is a window, a reason for none, a tick without a new bin (sin_bin), or a rejected reading with its reason.
OUTPUT = (
    "zone string, at_us long, bin long, status string, reason string, incomplete int, missing string, skipped int, means array<double>, present int, expected int, "
    "accepted long, late long, superseded long, not_finite long, device_id string, ts_us long, value double"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
#: What the state rejects, and what never reaches it.
STATE_REASONS, MESSAGE_REASONS = ("late", "superseded", "not_finite"), ("json", "field", "time", "naive_time", "value", "unknown")


def read_messages(raw: DataFrame, meters: DataFrame, magnitude: str = "value") -> tuple[DataFrame, DataFrame]:
    """(readings with their registered zone, rejected messages with a reason), both of a stream or a table.

    ``raw`` has a JSON text ``value`` and its ``arrival_us``. A reading needs device_id, timestamp_utc with a zone, and a
    finite number under ``magnitude``; other keys are ignored, a zone in the message too. Reasons: json (no JSON object),
    field (one is absent), time (no time), naive_time (a time without a zone), value (no finite number), unknown (not in
    the registry). Two registry rows for a device are an error of the registry; the smaller zone counts.
    """
    schema = f"device_id string, timestamp_utc string, `{magnitude}` string, __broken string"
    m = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    rows = raw.select("arrival_us", F.col("value").alias("message"), m.alias("m"))
    time = F.col("m.timestamp_utc")
    number = F.col(f"m.`{magnitude}`").try_cast("double")
    at = F.try_to_timestamp(time)
    own = F.length(F.coalesce("m.device_id", F.lit(""))) == 0
    problem = (
        F.when(F.col("m").isNull() | F.col("m.__broken").isNotNull() | (F.trim("message") == "") | F.trim("message").startswith("["), "json")
        .when(own | time.isNull() | F.col(f"m.`{magnitude}`").isNull(), "field")
        .when(at.isNull(), "time")
        .when(~time.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), "naive_time")
        .when(~finite(number), "value")
    )
    zones = meters.groupBy("device_id").agg(F.min("zone").alias("zone"))
    parsed = rows.select("arrival_us", "message", F.col("m.device_id").alias("device_id"), F.unix_micros(at).alias("ts_us"), number.alias("value"), problem.alias("reason"))
    known = parsed.join(zones, "device_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("zone").isNull(), "unknown")))
    accepted = known.where("reason is null").select("zone", "device_id", "ts_us", "value", "arrival_us")
    return accepted, known.where("reason is not null").select("arrival_us", "message", "zone", "device_id", "ts_us", "value", "reason")


class ZoneProcessor(StatefulProcessor):
    """A zone's cells, marks and counters as state; emission at timers, or at the newest arrival of a batch.

    ``clock`` is "processing" (timers every ``interval_ms``, also for silent zones) or "arrival": a batch's readings come first, then
    one emission at the time of the newest of them, so that a history of messages gives the same rows at every run.
    With timers, cells expire some windows after they were written, so a zone that left the registry leaves no state behind; with
    arrivals a query can end once all is read.
    """

    def __init__(self, config: WindowConfig = WindowConfig(), interval_ms: int = 3000, clock: str = "processing", idle: bool = True):
        if clock not in ("processing", "arrival"):
            raise ValueError("clock is processing or arrival")
        self.config, self.interval, self.clock, self.idle = config, interval_ms, clock, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        keep = max(3_600_000, 4 * (self.config.length + SLACK) * self.config.bin_us // 1000)
        self.cells = handle.getMapState("cells", "bin long, device string", "ts_us long, value double", keep if self.clock == "processing" else None)
        self.devices = handle.getValueState("devices", "ids array<string>")
        self.marks = handle.getValueState("marks", "first_bin long, emitted long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.devices.update((sorted(x for ids in initialState["devices"] for x in ids),))
        if self.clock == "processing":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.interval)

    def _cycle(self, zone: str, readings: list[tuple], now_us: int) -> Iterator[pd.DataFrame]:
        devices = list(self.devices.get()[0]) if self.devices.exists() else []
        first, emitted = self.marks.get() if self.marks.exists() else (None, None)
        before = {(k[0], k[1]): (v[0], v[1]) for k, v in self.cells.iterator()}
        state, known, rows = ZoneState(dict(before), first, emitted), frozenset(devices), []
        for _, device, ts_us, value in readings:
            verdict = observe(state, device, ts_us, value, None, known, self.config)
            if verdict != "accepted":
                rows.append({"zone": zone, "at_us": now_us, "status": "rejected", "reason": verdict, "device_id": device, "ts_us": ts_us, "value": value})
        row = emit(state, zone, now_us, devices, self.config)
        if row is None and self.idle:
            row = {"zone": zone, "status": "sin_bin", "skipped": 0}
        if row is not None or any(state.counts.values()):
            row = row or {"zone": zone, "status": "sin_bin", "skipped": 0}
            gone = len(row["missing"].split(",")) if row.get("missing") else 0
            rows.append(row | {"at_us": now_us, "present": len(devices) - gone, "expected": len(devices)} | {c: state.counts[c] for c in ("accepted", *STATE_REASONS)})
        for key in before.keys() - state.cells.keys():
            self.cells.removeKey(key)
        for key, value in state.cells.items():
            if before.get(key) != value:
                self.cells.updateValue(key, value)
        self.marks.update((state.first_bin, state.emitted))
        if rows:
            yield pd.DataFrame(rows).reindex(columns=COLUMNS).astype(object).where(lambda x: x.notna(), None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = sorted(x for pdf in rows for x in zip(pdf["arrival_us"].astype(int), pdf["device_id"], pdf["ts_us"].astype(int), pdf["value"].astype(float), strict=True))
        if self.clock == "arrival":
            yield from self._cycle(key[0], found, int(found[-1][0]))
        else:
            yield from self._cycle(key[0], found, timerValues.getCurrentProcessingTimeInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.interval)
        yield from self._cycle(key[0], [], now * 1000)

    def close(self) -> None:
        return


def live(raw: DataFrame, meters: DataFrame, plans: DataFrame, config: WindowConfig = WindowConfig(), magnitude: str = "value", interval_ms: int = 3000, clock: str = "processing", idle: bool = True) -> DataFrame:
    """Rows of OUTPUT (less means) with the detector's columns: the one streaming query from messages to detections.

    ``plans`` is of ``detect.plans``, a table rather than a query, as every micro-batch reads it. A zone without a plan gives
    windows without a detection. The session needs RocksDB as its state store (``processor.STATE_STORE``).
    """
    accepted, refused = read_messages(raw, meters, magnitude)
    start = meters.groupBy("zone").agg(F.collect_set("device_id").alias("devices")).groupBy("zone")
    rows = accepted.groupBy("zone").transformWithStateInPandas(ZoneProcessor(config, interval_ms, clock, idle), OUTPUT, "Append", "ProcessingTime" if clock == "processing" else "None", initialState=start)
    scored = detect.scan(rows, plans).drop("means")
    refused = refused.select("zone", F.col("arrival_us").alias("at_us"), F.lit("rejected").alias("status"), "reason", "device_id", "ts_us", "value", "message")
    return scored.unionByName(refused, allowMissingColumns=True)


def tail(rows: DataFrame, seconds: float = 300.0, now_us=None) -> DataFrame:
    """The rows that arrived in the last seconds, of a stream (by its own clock at each batch) or of a table."""
    now = F.unix_micros(F.current_timestamp()) if now_us is None else now_us
    return rows.where(F.col("arrival_us") > now - int(seconds * 1_000_000))


def route(path: str):
    """A foreachBatch function: windows and reasons to one table, rejected messages to another, counts to a third; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            rejected = F.col("status") == "rejected"
            own = ("device_id", "ts_us", "value", "message")
            batch.where(~rejected).drop(*own).write.mode("overwrite").parquet(f"{path}/windows/batch={batch_id}")
            batch.where(rejected).select("zone", "at_us", "reason", *own).write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
            series(batch).write.mode("overwrite").parquet(f"{path}/series/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def series(batch: DataFrame) -> DataFrame:
    """(series, zone, label, value) of a batch of ``live``, as an exporter shows them.

    Counts: windows, detections, without_window by reason, skipped_bins and readings by result (messages without a zone
    under none). Gauges, of each zone's newest window or reason: present, expected, statistic and threshold.
    """
    status, newest = F.col("status"), lambda c, when: F.max_by(F.col(c), F.when(when, F.col("at_us")))
    tried = status.isin("ventana", "sin_datos")
    zones = batch.groupBy("zone").agg(
        F.count_if(status == "ventana").cast("double").alias("windows"), F.count_if(F.col("detected")).cast("double").alias("detections"), F.sum("skipped").cast("double").alias("skipped_bins"),
        newest("present", tried).cast("double").alias("present"), newest("expected", tried).cast("double").alias("expected"),
        newest("statistic", status == "ventana").alias("statistic"), newest("threshold", status == "ventana").alias("threshold"), F.sum("accepted").cast("double").alias("accepted"),
    )
    gauges = zones.unpivot("zone", [c for c in zones.columns if c not in ("zone", "accepted")], "series", "value").select("series", "zone", F.lit("").alias("label"), "value")
    none = batch.where("status = 'sin_datos'").groupBy("zone", "reason").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("without_window").alias("series"), "zone", F.col("reason").alias("label"), "value")
    bad = batch.where("status = 'rejected'").groupBy("zone", "reason").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("readings").alias("series"), "zone", F.col("reason").alias("label"), "value")
    good = zones.select(F.lit("readings").alias("series"), "zone", F.lit("accepted").alias("label"), F.col("accepted").alias("value"))
    return gauges.unionByName(none).unionByName(bad).unionByName(good).where("value is not null")
