"""The live path: readings in, windows or reasons out, keyed by zone.

``step`` is the pure transition: it takes a zone's state, new readings and the wall clock, and returns the rows to
emit. The stateful stream and the batch replay share it, so both give the same rows for the same ordered input.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tasks import spread
from ..operators.windows import WindowConfig

#: Bins that are kept behind the window.
SLACK = 4
OUTPUT = "zone string, bin long, status string, reason string, incomplete int, missing string, skipped int, means array<double>"
#: RocksDB keeps several columns of state per key, which the default provider doesn't.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


COUNTERS = ("accepted", "unknown", "not_finite", "future", "late", "superseded")


@dataclass
class ZoneState:
    """A zone's cells (bin, device) -> (event time, value), the first bin seen, the last bin emitted, and counters."""

    cells: dict = field(default_factory=dict)
    first_bin: int | None = None
    emitted: int | None = None
    counts: dict = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))


def observe(state: ZoneState, device: str, ts_us: int, value: float, now_us: int | None, devices: Collection[str], config: WindowConfig) -> str:
    """File one reading: the latest event of a cell wins, of equal times the first to arrive."""
    at = ts_us // config.bin_us
    if device not in devices:
        verdict = "unknown"
    elif value is None or not math.isfinite(value):
        verdict = "not_finite"
    elif now_us is not None and ts_us - now_us > config.max_future_us:
        verdict = "future"
    elif state.emitted is not None and at <= state.emitted:
        verdict = "late"
    else:
        before = state.cells.get((at, device))
        state.first_bin = at if state.first_bin is None else min(state.first_bin, at)
        if before is not None:
            state.counts["superseded"] += 1
        if before is None or ts_us > before[0]:
            state.cells[at, device] = (ts_us, value)
            state.counts["accepted"] += 1
        return "accepted" if before is None or ts_us > before[0] else "superseded"
    state.counts[verdict] += 1
    return verdict


def emit(state: ZoneState, zone: str, now_us: int, devices: list[str], config: WindowConfig) -> dict | None:
    """The newest closed bin's window or the reason for none; at most once a bin, and never again."""
    last = (now_us - config.grace_us) // config.bin_us - 1
    if last < 0 or (state.emitted is not None and last <= state.emitted):
        return None
    skipped = 0 if state.emitted is None else last - state.emitted - 1
    state.emitted = last
    bins = range(last - config.length + 1, last + 1)
    gaps = {b: [d for d in devices if (b, d) not in state.cells] for b in bins}
    partial = [b for b in bins if gaps[b]]
    row = {"zone": zone, "bin": last, "status": "sin_datos" if partial else "ventana", "reason": None, "incomplete": len(partial), "missing": None, "skipped": skipped, "means": None}
    if partial:
        row["reason"] = "calentamiento" if state.first_bin is None or bins[0] < state.first_bin else "bins_incompletos"
        row["missing"] = ",".join(sorted({d for b in partial for d in gaps[b]}))
    else:
        row["means"] = [sum(state.cells[b, d][1] for b in bins) / config.length for d in devices]
    for key in [k for k in state.cells if k[0] < last - config.length - SLACK]:
        del state.cells[key]
    return row


def step(state: ZoneState, zone: str, readings: list[tuple], now_us: int, devices: list[str], config: WindowConfig) -> list[dict]:
    known = frozenset(devices)
    for device, ts_us, value in readings:
        observe(state, device, ts_us, value, None, known, config)
    row = emit(state, zone, now_us, devices, config)
    return [row] if row else []


def replay(readings: DataFrame, devices: DataFrame, clock: DataFrame, config: WindowConfig = WindowConfig(), idle: bool = False) -> DataFrame:
    """Batch twin: readings (zone, id, device_id, ts_us, value, arrival_us) against an emission schedule (zone, at_us).

    With ``idle``, a tick without a new bin gives a row sin_bin. A reading's zone is its device's in ``devices``, whatever the reading says; readings of other devices take no part.
    Devices, readings and ticks of a zone become one line in time (devices first; a reading that arrives at a
    tick comes before it), which a task walks through with the zone's state alone in memory, never its history.
    """
    none = {"device_id": "string", "ts_us": "long", "value": "double", "id": "long"}
    empty = lambda *names: [F.lit(None).cast(none[n]).alias(n) for n in names]
    line = (
        devices.select("zone", F.lit(-(1 << 63)).cast("long").alias("at"), F.lit(0).alias("kind"), *empty("id"), "device_id", *empty("ts_us", "value"))
        .unionByName(readings.drop("zone").join(devices.select("zone", "device_id"), "device_id").select("zone", F.col("arrival_us").alias("at"), F.lit(1).alias("kind"), "id", "device_id", "ts_us", F.col("value").cast("double").alias("value")))
        .unionByName(clock.select("zone", F.col("at_us").alias("at"), F.lit(2).alias("kind"), *empty("id", "device_id", "ts_us", "value")))
        .where("zone is not null")
    )
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zone, state, known, listed = None, ZoneState(), set(), []
        for pdf in it:
            out = []
            for r in zip(pdf["zone"], pdf["at"], pdf["kind"], pdf["device_id"], pdf["ts_us"], pdf["value"], strict=True):
                if r[0] != zone:
                    zone, state, known, listed = r[0], ZoneState(), set(), []
                if r[2] == 0:
                    known.add(r[3])
                elif r[2] == 1:
                    observe(state, r[3], int(r[4]), r[5], None, known, config)
                else:
                    if len(listed) != len(known):
                        listed = sorted(known)
                    row = emit(state, zone, int(r[1]), listed, config)
                    if row or idle:
                        out.append(row or dict.fromkeys(names) | {"zone": zone, "status": "sin_bin", "incomplete": 0, "skipped": 0})
            if out:
                yield pd.DataFrame(out, columns=names).astype({"bin": "Int64"})

    return spread(line, "zone").sortWithinPartitions("zone", "at", "kind", "id").mapInPandas(walk, OUTPUT)
