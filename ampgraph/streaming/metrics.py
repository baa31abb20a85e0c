"""Operational metrics of the live path: counters observed in the plan, and progress of each micro-batch."""

from __future__ import annotations

import logging
import time
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..errors import TopologyMismatch

log = logging.getLogger(__name__)


#: Series of the live path by kind of row; gauges are of the newest batch, the others add up.
GAUGES = ("newest_bin", "largest_statistic", "incomplete_bins")


def counted(rows: DataFrame, name: str = "monitor") -> DataFrame:
    """``rows`` of the live path with observed series; they cost no extra pass and no extra job.

    Cycles, windows and missing windows by reason, skipped and incomplete bins, missing meters, the newest bin; with
    the detector's columns also detections and the largest statistic.
    """
    status = F.col("status")
    series = [F.count(F.lit(1)).alias("cycles"), F.count_if(status == "ventana").alias("windows"), F.count_if(status == "sin_datos").alias("missing")]
    if "reason" in rows.columns:
        series += [F.count_if(F.col("reason") == "calentamiento").alias("warming_up"), F.count_if(F.col("reason") == "bins_incompletos").alias("incomplete")]
    more = {
        "skipped": F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped_bins"),
        "bin": F.max("bin").alias("newest_bin"),
        "missing": F.coalesce(F.sum(F.when(F.length("missing") > 0, F.size(F.split("missing", ",")))), F.lit(0)).alias("missing_meters"),
        "detected": F.count_if("detected").alias("detections"),
        "statistic": F.max("statistic").alias("largest_statistic"),
    }
    if "incomplete" in rows.columns:
        series.append(F.coalesce(F.sum("incomplete"), F.lit(0)).alias("incomplete_bins"))
    return rows.observe(name, *series, *(c for k, c in more.items() if k in rows.columns))


def observed_readings(verdicts: DataFrame, name: str = "readings") -> DataFrame:
    """Readings with a verdict, with observed counts of each kind."""
    kinds = ("accepted", "unknown", "future", "late", "superseded")
    return verdicts.observe(name, F.count(F.lit(1)).alias("readings"), *(F.count_if(F.col("verdict") == k).alias(k) for k in kinds))


class Totals(StreamingQueryListener):
    """Running totals over micro-batches, and what the newest one added."""

    def __init__(self):
        self.total, self.delta, self.gauges, self.batches, self.failed, self.rows, self.seconds = Counter(), {}, {}, 0, 0, 0, 0.0
        self.cycle, self.publish_failures, self.running = 0.0, 0, 0

    def series(self) -> dict[str, float]:
        """Series of the process, beside those by zone in ``live.series``: the last cycle's seconds, cycles, failed publications, and whether a query runs."""
        return {"cycle_seconds": self.cycle, "cycles": self.batches, "failed_publications": self.publish_failures, "connected": float(self.running > 0)}

    def onQueryStarted(self, event) -> None:
        self.running += 1

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.delta = {k: v for row in event.progress.observedMetrics.values() for k, v in row.asDict().items()}
        self.rows += event.progress.numInputRows
        self.cycle = event.progress.batchDuration / 1000
        self.seconds += self.cycle
        self.gauges |= {k: v for k, v in self.delta.items() if k in GAUGES and v is not None}
        self.total.update({k: v for k, v in self.delta.items() if k not in GAUGES and v is not None})

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        self.running -= 1
        self.failed += event.exception is not None
        self.publish_failures += "PublishError" in (event.exception or "")


def topology_guard(armed: DataFrame, live, publish, every_s: float = 0.0, clock=time.monotonic, results: Counter | None = None):
    """A foreachBatch function: publishes while the live fingerprints are the armed ones; a change is fatal.

    The registry is read again once ``every_s`` seconds have passed since it last was (0: for each batch). ``results`` counts the
    checks by result: equal, changed or unreadable.

    ``live`` makes the current (zone, fingerprint) table; if it can't be read, whatever the reason, that is logged
    and publishing goes on.
    """

    last = [None]

    def run(batch: DataFrame, batch_id: int) -> None:
        if last[0] is not None and clock() - last[0] < every_s:
            publish(batch, batch_id)
            return
        last[0] = clock()
        try:
            now = live()
            changed = armed.join(now.withColumnRenamed("fingerprint", "__now"), "zone", "full").where(~F.col("fingerprint").eqNullSafe(F.col("__now"))).take(1)
        except Exception as e:  # noqa: BLE001  Spark's, py4j's and the file system's own errors
            log.warning("the registry can't be read, topology isn't checked: %s", e)
            changed, result = [], "unreadable"
        else:
            result = "changed" if changed else "equal"
        if results is not None:
            results[result] += 1
        if changed:
            raise TopologyMismatch(f"zone {changed[0]['zone']} isn't what its threshold was calibrated for")
        publish(batch, batch_id)

    return run
