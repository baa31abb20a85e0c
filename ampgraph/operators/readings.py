"""Aggregates of readings and meters that screens and calibration read: each one pass, with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def horizon(readings: DataFrame, hours: int = 24) -> DataFrame:
    """(since, until): the last hours of event time."""
    until = F.max("ts_us")
    return readings.agg(until.alias("until"), (until - hours * HOUR_US).alias("since"))


def within(readings: DataFrame, span: DataFrame) -> DataFrame:
    """Readings of the one span (since, until), the end left out."""
    rows = readings.join(F.broadcast(span.limit(1)), (F.col("ts_us") >= F.col("since")) & (F.col("ts_us") < F.col("until")))
    return rows.drop("since", "until")


def spatial_sigma(readings: DataFrame, value: str, width_us: int, least: int = 10) -> DataFrame:
    """(device_type, instants, meters_per_instant, mean, sigma): spread between meters at the same time, averaged over instants.

    Instants with fewer than ``least`` readings of a type are left out; variances are averaged, not spreads.
    """
    at = F.floor(F.col("ts_us") / width_us).cast("long").alias("at")
    each = readings.groupBy("device_type", at).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where(F.col("n") >= least)
    return each.groupBy("device_type").agg(F.count(F.lit(1)).alias("instants"), F.avg("n").alias("meters_per_instant"), F.avg("m").alias("mean"), F.sqrt(F.avg("v")).alias("sigma"))


def profile(readings: DataFrame, magnitudes: list[str]) -> DataFrame:
    """(device_type, magnitude, n, mean, sigma, least, most): a row for each type and magnitude, from one scan."""
    rows = readings.select("device_type", *magnitudes).unpivot("device_type", magnitudes, "magnitude", "v")
    return rows.groupBy("device_type", "magnitude").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sigma"), F.min("v").alias("least"), F.max("v").alias("most"))


def relative_spread(readings: DataFrame, value: str, *by: str) -> DataFrame:
    """Spread over mean of each group."""
    return readings.groupBy(*by).agg((F.stddev_samp(value) / F.avg(value)).alias("spread"))


def meters_by(readings: DataFrame, *by: str, name: str = "meters") -> DataFrame:
    """Different meters of each group."""
    return readings.groupBy(*by).agg(F.count_distinct("device_id").alias(name))


def means(readings: DataFrame, values: list[str], *by: str) -> DataFrame:
    """Means of several columns by group, nulls left out."""
    return readings.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values))


def bins(cells: DataFrame) -> DataFrame:
    """(zone, bin, meters, readings, multiple, most) of cells (zone, device_id, bin, n)."""
    return cells.groupBy("zone", "bin").agg(F.count(F.lit(1)).alias("meters"), F.sum("n").alias("readings"), F.count_if(F.col("n") > 1).alias("multiple"), F.max("n").alias("most"))


def zone_counts(meters: DataFrame, none: str = "(sin zona)") -> DataFrame:
    """(zone, meters), those without a zone under one name."""
    return meters.groupBy(F.coalesce("zone", F.lit(none)).alias("zone")).agg(F.count(F.lit(1)).alias("meters"))


def arrival_rate(readings: DataFrame, *by: str) -> DataFrame:
    """Readings a second between the first and the last arrival of each group; 0 for one reading or no time."""
    span = F.max("arrival_us") - F.min("arrival_us")
    return readings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), span.alias("span")).select(*by, F.when((F.col("n") < 2) | (F.col("span") <= 0), 0.0).otherwise((F.col("n") - 1) / (F.col("span") / 1e6)).alias("rate"))


def message_rate(readings: DataFrame, *by: str) -> DataFrame:
    """Readings over the seconds of event time that each group spans; null where it spans none."""
    span = F.max("ts_us") - F.min("ts_us")
    return readings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), span.alias("span")).select(*by, F.when(F.col("span") > 0, F.col("n") / (F.col("span") / 1e6)).alias("rate"))


def age_seconds(at_us: Column, now_us: Column) -> Column:
    """Seconds since a time, none below 0."""
    return F.greatest(F.lit(0.0), (now_us - at_us) / 1e6)


def with_now(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """``rows`` with ``now``, the newest arrival: the clock of a stored history."""
    return rows.crossJoin(F.broadcast(readings.agg(F.max("arrival_us").alias("now"))))


def box_density(points: DataFrame) -> DataFrame:
    """(zone, density): meters a square kilometre of each zone's bounding box."""
    side = lambda c: (F.max(c) - F.min(c)) / 1000
    return points.groupBy("zone").agg((F.count(F.lit(1)) / (side("x") * side("y"))).alias("density"))


def curve(cells: DataFrame) -> DataFrame:
    """(zone, bin, y): mean values, to nine decimals, so that equal means compare as equal in whatever order tasks add them up."""
    return cells.groupBy("zone", "bin").agg(F.round(F.avg("value"), 9).alias("y"))


def edges_of_episodes(flags: DataFrame) -> DataFrame:
    """(zone, bin, rise): where a flag ``above`` comes up."""
    before = F.coalesce(F.lag("above").over(Window.partitionBy("zone").orderBy("bin")), F.lit(False))
    return flags.select("zone", "bin", (F.col("above") & ~before).alias("rise"))


def crossings(flags: DataFrame) -> DataFrame:
    """(zone, bin): where a flag ``above`` changes."""
    before = F.lag("above").over(Window.partitionBy("zone").orderBy("bin"))
    return flags.withColumn("before", before).where(F.col("above") != F.col("before")).select("zone", "bin")


def extrema(curve: DataFrame) -> DataFrame:
    """(zone, bin, kind): inner points of a curve (zone, bin, y) above or below both neighbours."""
    line = Window.partitionBy("zone").orderBy("bin")
    rows = curve.withColumns({"b": F.lag("y").over(line), "n": F.lead("y").over(line)})
    top, low = (F.col("y") > F.col("b")) & (F.col("y") > F.col("n")), (F.col("y") < F.col("b")) & (F.col("y") < F.col("n"))
    return rows.withColumn("kind", F.when(top, "max").when(low, "min")).where("kind is not null").select("zone", "bin", "kind")


def log_gradient(curve: DataFrame) -> DataFrame:
    """(zone, bin, gradient) of ln y over ln x of a curve (zone, bin, x, y): second order inside, one-sided at the ends, uneven steps."""
    line = Window.partitionBy("zone").orderBy("bin")
    logs = curve.select("zone", "bin", F.ln("x").alias("x"), F.ln("y").alias("y"))
    r = logs.withColumns({f"{c}{k}": f(c).over(line) for c in "xy" for k, f in (("b", F.lag), ("n", F.lead))})
    left, right = F.col("x") - F.col("xb"), F.col("xn") - F.col("x")
    inner = (left * left * F.col("yn") + (right * right - left * left) * F.col("y") - right * right * F.col("yb")) / (left * right * (left + right))
    ends = F.when(F.col("yb").isNull(), (F.col("yn") - F.col("y")) / right).when(F.col("yn").isNull(), (F.col("y") - F.col("yb")) / left)
    return r.select("zone", "bin", F.coalesce(ends, inner).alias("gradient"))


def zscores(signal: DataFrame) -> DataFrame:
    """(zone, t, idx, z): distance from an instant's mean in its spreads; a spread of nearly nothing counts as 1."""
    over = Window.partitionBy("zone", "t")
    spread = F.stddev_pop("value").over(over)
    return signal.select("zone", "t", "idx", (F.abs(F.col("value") - F.avg("value").over(over)) / F.when(spread < 1e-12, 1.0).otherwise(spread)).alias("z"))


def silent(meters: DataFrame, readings: DataFrame, span_us: int) -> DataFrame:
    """Meters from which nothing arrived within a span before the newest arrival."""
    heard = with_now(readings.select("device_id", "arrival_us"), readings).where(F.col("arrival_us") >= F.col("now") - span_us)
    return meters.join(heard.select("device_id"), "device_id", "left_anti")


#: The names that clients read.
TELEMETRY_NAMES = {
    "id": "reading_id", "device_id": "meter_id", "device_type": "kind", "zone": "zone_id", "ts_us": "event_time", "voltage": "voltage_v", "current": "current_a", "power": "power_kw",
    "energy": "energy_kwh", "frequency": "frequency_hz", "power_factor": "pf", "status": "state", "node": "origin", "arrival_us": "received_at",
}
METER_NAMES = {
    "device_id": "meter_id", "device_type": "kind", "zone": "zone_id", "lat": "latitude", "lon": "longitude", "node": "origin", "installed_us": "installed_at", "last_seen_us": "last_seen_at",
    "active": "is_active",
}


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The named columns under their other names, and no others."""
    return rows.select(*(F.col(c).alias(n) for c, n in names.items()))


def status_label(status: Column) -> Column:
    """A status as people read it."""
    return F.coalesce(F.replace(status, F.lit("_"), F.lit(" ")), F.lit("Sin clasificar"))


def kind_of(device_id: Column) -> Column:
    """The kind of meter that an id tells; null for others."""
    part = F.substring(device_id, 5, 3)
    return F.when(part == "mon", "monofasico").when(part == "tri", "trifasico")


def unknown(wanted: DataFrame, meters: DataFrame) -> DataFrame:
    """Zones of ``wanted`` that no meter is in."""
    return wanted.select("zone").distinct().join(meters.select("zone"), "zone", "left_anti")
