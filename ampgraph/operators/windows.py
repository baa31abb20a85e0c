"""Event-time bins, latest reading per cell, and dense windows without imputation.

A bin is ``floor(event time / width)``. A window is ``length`` consecutive bins in which every meter of the
zone has a reading; anything else is a reason row, never a guess.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import WindowError


@dataclass(frozen=True)
class WindowConfig:
    bin_us: int = 6_000_000
    length: int = 16
    grace_us: int = 5_000_000
    max_future_us: int = 60_000_000

    def __post_init__(self):
        if self.bin_us < 1 or self.length < 1 or self.grace_us < 0 or self.max_future_us < 0:
            raise WindowError("bin and length are positive, grace and future limit not negative")

    @property
    def span_us(self) -> int:
        return self.bin_us * self.length


def bin_of(ts_us: Column, width_us: int) -> Column:
    return F.floor(ts_us / F.lit(width_us)).cast("long")


def last_closed(now_us: Column, config: WindowConfig) -> Column:
    """The newest bin that ended at least the grace ago; null before the first one."""
    closed = F.floor((now_us - config.grace_us) / F.lit(config.bin_us)).cast("long") - 1
    return F.when(closed >= 0, closed)


def cells(readings: DataFrame, width_us: int, value: str = "value") -> DataFrame:
    """(zone, device_id, bin, value, n): the latest event of each cell; of equal times the first to arrive."""
    rows = readings.withColumn("bin", bin_of(F.col("ts_us"), width_us))
    # max_by over (time, -arrival) aggregates before the shuffle, unlike a ranking window
    return rows.groupBy("zone", "device_id", "bin").agg(F.max_by(value, F.struct("ts_us", -F.col("id"))).alias("value"), F.count(F.lit(1)).alias("n"))


def classify(readings: DataFrame, meters: DataFrame, emitted: DataFrame, config: WindowConfig) -> DataFrame:
    """``readings`` with a ``verdict``: unknown, future, late, superseded or accepted.

    ``emitted`` is (zone, at_us, bin): which bins had been emitted when. A reading is late if its bin is at or
    below the newest bin emitted before it arrived. In a cell the largest event time wins, then the first arrival.
    """
    known = readings.join(meters.select("device_id", F.col("zone").alias("__zone")), "device_id", "left")
    rows = known.withColumns({"bin": bin_of(F.col("ts_us"), config.bin_us), "__at": F.col("arrival_us"), "__b": F.lit(None).cast("long"), "__kind": F.lit(1)})
    # emissions and arrivals in one time line per zone, emissions first: a running maximum, where a join by time would meet all pairs
    marks = emitted.select(F.col("zone").alias("__zone"), F.col("at_us").alias("__at"), F.col("bin").alias("__b"), F.lit(0).alias("__kind"))
    # unknown devices have no zone, and each is a line of its own
    key = F.coalesce(F.col("__zone"), F.concat(F.lit("?"), F.col("device_id")))
    line = Window.partitionBy(key, F.col("__zone").isNull()).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.unionByName(marks, allowMissingColumns=True).withColumn("__newest", F.max("__b").over(line)).where("__kind = 1")
    first = (
        F.when(F.col("__zone").isNull(), "unknown")
        .when(F.col("ts_us") - F.col("arrival_us") > config.max_future_us, "future")
        .when(F.col("bin") <= F.col("__newest"), "late")
    )
    cell = Window.partitionBy("device_id", "bin", first.isNull()).orderBy(F.desc("ts_us"), "arrival_us", "id")
    return rows.withColumn("verdict", F.coalesce(first, F.when(F.row_number().over(cell) > 1, "superseded").otherwise("accepted"))).drop("__zone", "__newest", "__at", "__b", "__kind")


def completeness(cell_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(zone, bin, present, n, complete) of every bin between each zone's first and last, absent ones included."""
    seen = cell_rows.groupBy("zone", "bin").agg(F.count(F.lit(1)).alias("present"))
    spans = seen.groupBy("zone").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    grid = spans.select("zone", F.explode(F.sequence("lo", "hi")).alias("bin"))
    return grid.join(seen, ["zone", "bin"], "left").join(sizes, "zone").select("zone", "bin", F.coalesce("present", F.lit(0)).alias("present"), "n", (F.coalesce("present", F.lit(0)) == F.col("n")).alias("complete"))


def completeness_report(readings: DataFrame, sizes: DataFrame, widths_us: list[int], length: int) -> DataFrame:
    """A row for each width and zone: how whole its bins and windows of ``length`` bins are.

    Bins without a reading count as empty. The first and the last bin are cut by the horizon and left out, where there
    are more than two. Columns: n, bins, full_bins, empty_bins, partial_bins, bin_share, window_share (of all windows in the range), missing
    meters of partial bins (p50, p95, most), cells, multiple_cells, multiple_share, most_readings, readings. Readings of zones
    that ``sizes`` (zone, n) doesn't have are left out.
    """
    width = F.explode(F.array(*(F.lit(w).cast("long") for w in widths_us)))
    rows = readings.select("zone", "device_id", "ts_us", width.alias("width"))
    cell = rows.groupBy("width", "zone", "device_id", F.floor(F.col("ts_us") / F.col("width")).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    bins = cell.groupBy("width", "zone", "bin").agg(F.count(F.lit(1)).alias("present"), F.sum("k").alias("readings"), F.count_if(F.col("k") > 1).alias("multiple"), F.max("k").alias("most"))
    totals = bins.groupBy("width", "zone").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.sum("present").alias("cells"), F.sum("multiple").alias("multiple_cells"), F.max("most").alias("most_readings"), F.sum("readings").alias("readings"))
    totals = totals.join(sizes, "zone").withColumn("inner", (F.col("hi") - F.col("lo") > 1).cast("long"))
    grid = totals.select("width", "zone", "n", "lo", "hi", "inner", F.explode(F.sequence(F.col("lo") + F.col("inner"), F.col("hi") - F.col("inner"))).alias("bin"))
    series = grid.join(bins.select("width", "zone", "bin", "present"), ["width", "zone", "bin"], "left").fillna(0, ["present"])
    line = Window.partitionBy("width", "zone").orderBy("bin").rangeBetween(-(length - 1), 0)
    full = F.col("present") == F.col("n")
    series = series.withColumns({"full": full, "run": F.sum(full.cast("long")).over(line), "whole": F.col("bin") - (F.col("lo") + F.col("inner")) >= length - 1})
    partial = (F.col("present") > 0) & ~F.col("full")
    lacking = F.when(partial, F.col("n") - F.col("present"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    stats = series.groupBy("width", "zone").agg(
        F.count(F.lit(1)).alias("bins"), F.count_if("full").alias("full_bins"), F.count_if(F.col("present") == 0).alias("empty_bins"), F.count_if(partial).alias("partial_bins"), F.avg(F.col("full").cast("double")).alias("bin_share"),
        share(F.count_if(F.col("whole") & (F.col("run") == length)), F.count_if("whole")).alias("window_share"), F.coalesce(F.percentile(lacking, F.lit(0.5)), F.lit(0.0)).alias("missing_p50"),
        F.coalesce(F.percentile(lacking, F.lit(0.95)), F.lit(0.0)).alias("missing_p95"), F.coalesce(F.max(lacking), F.lit(0)).alias("missing_most"),
    )
    kept = totals.select("width", "zone", "n", "cells", "multiple_cells", share(F.col("multiple_cells"), F.col("cells")).alias("multiple_share"), "most_readings", "readings")
    return stats.join(kept, ["width", "zone"])


def choose_width(report: DataFrame, length: int, target: float = 0.95) -> DataFrame:
    """(width, rule, worst, window_us, limiting_zone): the least width whose worst zone reaches the target (rule "target").

    If there is none, the width whose worst zone is best, the lesser on ties (rule "best"). The limiting zone is that of the least
    share, the first by name on ties. One row, or none for an empty report.
    """
    worst = report.groupBy("width").agg(F.min("window_share").alias("worst"), F.min(F.struct("window_share", "zone")).alias("w"))
    meets = F.col("worst") >= target
    first = worst.withColumn("rule", F.when(meets, "target").otherwise("best")).orderBy(F.desc(meets), F.when(meets, F.col("width")).otherwise(0), F.when(meets, 0.0).otherwise(-F.col("worst")), "width").limit(1)
    return first.select("width", "rule", "worst", (F.col("width") * length).alias("window_us"), F.col("w.zone").alias("limiting_zone"))


def check_fit(frozen: DataFrame, live: DataFrame) -> DataFrame:
    """(zone, threshold_window, bin_window, fits): a threshold holds only for windows of the bins that it was frozen for.

    ``frozen`` is (zone, window), ``live`` (zone, length); a zone without a threshold doesn't fit.
    """
    both = live.join(frozen, "zone", "left")
    return both.select("zone", F.col("window").alias("threshold_window"), F.col("length").alias("bin_window"), F.coalesce(F.col("window") == F.col("length"), F.lit(False)).alias("fits"))


def zone_sizes(meters: DataFrame) -> DataFrame:
    return meters.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


def window_status(cell_rows: DataFrame, sizes: DataFrame, length: int) -> DataFrame:
    """(zone, bin, status, incomplete, reason) of the window that ends at each bin.

    ``ventana`` if all of its bins are complete; else ``sin_datos``, for the reason ``calentamiento`` where the
    window starts before the zone's first bin, or ``bins_incompletos``. incomplete counts bins.
    """
    rows = completeness(cell_rows, sizes)
    frame = Window.partitionBy("zone").orderBy("bin").rangeBetween(-(length - 1), 0)
    whole = F.sum(F.col("complete").cast("long")).over(frame)
    first = F.min("bin").over(Window.partitionBy("zone"))
    status = rows.withColumns({"incomplete": F.lit(length) - whole, "first": first})
    reason = F.when(F.col("incomplete") == 0, None).when(F.col("bin") - (length - 1) < F.col("first"), "calentamiento").otherwise("bins_incompletos")
    return status.select("zone", "bin", F.when(F.col("incomplete") == 0, "ventana").otherwise("sin_datos").alias("status"), F.col("incomplete").cast("long").alias("incomplete"), reason.alias("reason"))


def missing_cells(cell_rows: DataFrame, meters: DataFrame) -> DataFrame:
    """(zone, bin, device_id) of meters without a reading in a bin of their zone's range."""
    spans = cell_rows.groupBy("zone").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    grid = spans.select("zone", F.explode(F.sequence("lo", "hi")).alias("bin")).join(meters.select("zone", "device_id"), "zone")
    return grid.join(cell_rows.select("zone", "bin", "device_id"), ["zone", "bin", "device_id"], "left_anti")


def dense_means(cell_rows: DataFrame, points: DataFrame, length: int) -> DataFrame:
    """(zone, bin, idx, mean) of each window that is complete for its whole zone, by its last bin.

    The frame is over bin numbers, not rows, so that a gap never passes unseen.
    """
    rows = cell_rows.join(points.select("zone", "device_id", "idx"), ["zone", "device_id"])
    frame = Window.partitionBy("zone", "idx").orderBy("bin").rangeBetween(-(length - 1), 0)
    rows = rows.select("zone", "bin", "idx", F.avg("value").over(frame).alias("mean"), F.count("value").over(frame).alias("filled"))
    size = points.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    full = rows.where(F.col("filled") == length).groupBy("zone", "bin").agg(F.count(F.lit(1)).alias("ready")).join(size, "zone").where("ready = n")
    return rows.where(F.col("filled") == length).join(full.select("zone", "bin"), ["zone", "bin"], "left_semi").select("zone", "bin", "idx", "mean")


def window_starts(instants: int, length: int, step: int | None = None) -> list[int]:
    """Starts of all whole windows; tumbling unless a step is given."""
    return list(range(0, instants - length + 1, step or length))
