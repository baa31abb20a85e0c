"""Sources: the metered-network relations, bound to the driver's event table, and JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import CalibrationError, IncompleteMeter, NoMetersFound, SourceError, SourceTimeout

#: Meters of one zone in the binding.
PER_ZONE = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def device_id(user):
    kind = F.when(user % 3 == 0, "tri").otherwise("mon")
    return F.concat(F.lit("dev-"), kind, F.lit("-"), F.lpad(user.cast("string"), 8, "0"))


def zone_of(user):
    return F.concat(F.lit("z"), F.lpad(F.floor(user / PER_ZONE).cast("string"), 6, "0"))


def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: one row per meter that has events. ``active`` is null for some, false for others."""
    u = F.col("user_id")
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("installed_us"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_seen_us"))
    return seen.select(
        device_id(u).alias("device_id"),
        F.when(u % 3 == 0, "tri").otherwise("mono").alias("device_type"),
        zone_of(u).alias("zone"),
        (F.lit(5.03) + ((u * 7919) % 9000) / F.lit(1e5)).cast("double").alias("lat"),
        (F.lit(-75.55) + ((u * 104729) % 11000) / F.lit(1e5)).cast("double").alias("lon"),
        F.concat(F.lit("n"), (u % 4).cast("string")).alias("node"),
        "installed_us",
        "last_seen_us",
        F.when(u % 11 == 0, None).otherwise(u % 7 != 0).alias("active"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings: one row per event, with event time, arrival time and measures in microseconds and doubles."""
    u, v = F.col("user_id"), F.round(F.col("value") * 100).cast("long")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    status = F.array(*map(F.lit, ("activo", "mantenimiento", "falla", "activo", "corte", "activo")))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        device_id(u).alias("device_id"),
        F.when(u % 3 == 0, "tri").otherwise("mono").alias("device_type"),
        zone_of(u).alias("zone"),
        ts.alias("ts_us"),
        (ts + ((F.col("event_id") * 37) % 4000 - 600) * 1000).alias("arrival_us"),
        (F.lit(200e0) + (v % 4000) / F.lit(100e0)).alias("voltage"),
        ((v % 600) / F.lit(10e0)).alias("current"),
        ((v % 3000) / F.lit(100e0)).alias("power"),
        F.when(v % 17 != 0, v / F.lit(1000e0)).alias("energy"),
        (F.lit(59e0) + (v % 200) / F.lit(100e0)).alias("frequency"),
        (F.lit(0.5e0) + (v % 50) / F.lit(100e0)).alias("power_factor"),
        F.when(v % 7 != 6, F.element_at(status, (v % 7 + 1).cast("int"))).alias("status"),
        F.concat(F.lit("n"), (u % 4).cast("string")).alias("node"),
        F.col("value").alias("value"),
    )


def load_meters(registry: DataFrame, zones: list[str] | None = None, only_active: bool = True, skip_incomplete: bool = False) -> DataFrame:
    """The registry's usable rows: by zone, not marked inactive (unknown counts as active), complete.

    Raises NoMetersFound for an empty scan, and IncompleteMeter for a null zone or coordinate unless skipped.
    """
    rows = registry
    if only_active:
        rows = rows.where(F.coalesce("active", F.lit(True)))
    if zones is not None:
        rows = rows.where(F.col("zone").isin(list(zones)))
    whole = F.col("zone").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    if not skip_incomplete and (bad := rows.where(~whole).select("device_id").take(5)):
        raise IncompleteMeter(f"meters without zone or coordinates: {[r[0] for r in bad]}")
    rows = rows.where(whole)
    if not rows.take(1):
        raise NoMetersFound(f"no meters in zones {zones}")
    return rows.orderBy("device_id")


def topology_json(spark: SparkSession, path: str) -> DataFrame:
    """(device_id, zona, lat, lon) of a topology document."""
    return parse_topology(spark.read.text(path, wholetext=True))


def profile_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_profile(spark.read.text(path, wholetext=True))


def bounds_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_bounds(spark.read.text(path, wholetext=True))


def calibration_json(spark: SparkSession, path: str, expected_format: str) -> DataFrame:
    return parse_calibration(spark.read.text(path, wholetext=True), expected_format)


def parse_topology(text: DataFrame) -> DataFrame:
    return text.select(F.explode(F.from_json("value", schemas.TOPOLOGY)["meters"]).alias("m")).select("m.*")


def parse_profile(text: DataFrame) -> DataFrame:
    """(magnitude, device_type, stat, value) of a nested magnitude -> type -> statistics document."""
    parsed = F.from_json(F.get_json_object("value", "$.magnitudes"), "map<string, map<string, map<string, double>>>")
    return (
        text.select(F.explode(parsed).alias("magnitude", "types"))
        .select("magnitude", F.explode("types").alias("device_type", "stats"))
        .select("magnitude", "device_type", F.explode("stats").alias("stat", "value"))
    )


def parse_bounds(text: DataFrame) -> DataFrame:
    """(magnitude, minimum, maximum) from a JSON Schema's number properties."""
    parsed = F.from_json(F.get_json_object("value", "$.properties"), "map<string, struct<minimum:double, maximum:double>>")
    rows = text.select(F.explode(parsed).alias("magnitude", "b")).select("magnitude", "b.minimum", "b.maximum")
    return rows.where("minimum is not null and maximum is not null")


def parse_calibration(text: DataFrame, expected_format: str) -> DataFrame:
    """One row per calibrated zone; a wrong format tag, no zones, or a threshold that isn't positive is an error."""
    doc = text.select(F.from_json("value", schemas.CALIBRATION).alias("d")).select("d.*")
    if not doc.where(F.col("format") == expected_format).take(1):
        raise CalibrationError(f"the calibration isn't of format {expected_format}")
    zones = doc.select("magnitude", F.explode("zones").alias("key", "z")).select("magnitude", "z.*")
    if not zones.take(1) or zones.where("threshold is null or threshold <= 0 or isnan(threshold)").take(1):
        raise CalibrationError("the calibration has no zones, or a threshold that isn't positive")
    return zones


def parse_records(text: DataFrame) -> DataFrame:
    """REST records, one JSON object a row, with English names; a time that can't be read is null."""
    fields = "reading_id long, meter_id string, zone_id string, event_time string, received_at string, voltage_v double, power_kw double, state string"
    rows = text.select(F.from_json("value", fields).alias("r")).select("r.*")
    return rows.withColumns({c: F.try_to_timestamp(c) for c in ("event_time", "received_at")})


def read_records(spark: SparkSession, url: str, timeout_s: float = 5.0) -> DataFrame | None:
    """One REST read as rows: nothing where the answer is 404; a time-out or another failure is a ``SourceError``.

    The body is one JSON array, fetched by the driver: an API pages its answers, so what comes at once is small. Tables
    are better read directly.
    """
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=timeout_s) as answer:
            body = answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise SourceError(f"{url}: status {e.code}") from e
    except (urllib.error.URLError, TimeoutError) as e:
        late = isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError)
        raise (SourceTimeout if late else SourceError)(f"{url}: {e}") from e
    found = json.loads(body)
    rows = found if isinstance(found, list) else [found]
    return parse_records(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))
