"""Ingest validation, the registry fold, and the reads that serve dashboards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from .tasks import spread

ID_PATTERN = "^dev-(mon|tri)-[0-9]{8}$"
#: Closed ranges that a producer keeps to.
RANGES = {"voltage": (187.0, 253.0), "current": (0.0, 60.0), "power": (0.0, 30.0), "frequency": (57.0, 63.0), "power_factor": (0.0, 1.0)}
#: Ranges of the older producer.
LEGACY_RANGES = {"voltage": (100.0, 130.0), "current": (0.0, 50.0), "frequency": (59.5, 60.5), "power_factor": (0.0, 1.0)}


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages as columns beside the raw text; a field that is broken or absent is null, extra keys are ignored."""
    return raw.withColumn("m", F.from_json(F.col(column), schemas.MESSAGE, {"mode": "PERMISSIVE"})).select(column, "m.*")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def valid_message(pattern: str = ID_PATTERN) -> Column:
    """Required fields present, the id of its form, times with a zone, measures finite."""
    zoned = F.col("timestamp_utc").rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    ok = F.col("device_id").rlike(pattern) & (F.length("device_id") <= 32) & zoned & F.try_to_timestamp(F.col("timestamp_utc")).isNotNull()
    for name in ("voltage", "current", "power", "frequency", "power_factor"):
        ok = ok & finite(F.col(name))
    return F.coalesce(ok, F.lit(False))


def in_ranges(ranges: dict[str, tuple[float, float]] = RANGES) -> Column:
    ok = F.lit(True)
    for name, (low, high) in ranges.items():
        ok = ok & F.col(name).between(low, high)
    return F.coalesce(ok, F.lit(False))


def valid_coordinates() -> Column:
    ok = (F.length("device_id") > 0) & (F.length("zone") > 0) & F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0)
    return F.coalesce(ok, F.lit(False))


def upsert(readings: DataFrame, order: str = "id", columns: tuple[str, ...] = ("device_type", "zone", "node")) -> DataFrame:
    """The registry after folding all readings in: a null never replaces a value, last_seen is the last arrival's.

    One aggregation: of each column the latest value that isn't null.
    """
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return readings.groupBy("device_id").agg(*last, F.max_by("arrival_us", order).alias("last_seen_us")).withColumn("active", F.lit(True))


def merge(registry: DataFrame, batch: DataFrame, columns: tuple[str, ...] = ("device_type", "zone", "node")) -> DataFrame:
    """A registry with a batch's fold on top, for streaming sinks."""
    new = batch.select("device_id", *(F.col(c).alias(f"__{c}") for c in columns), F.col("last_seen_us").alias("__seen"))
    both = registry.join(new, "device_id", "full")
    keep = [F.coalesce(f"__{c}", c).alias(c) for c in columns]
    return both.select("device_id", *keep, F.coalesce("__seen", "last_seen_us").alias("last_seen_us"), F.when(F.col("__seen").isNotNull(), True).otherwise(F.col("active")).alias("active"))


def latest(readings: DataFrame, by: str = "arrival_us") -> DataFrame:
    """Each device's latest reading, by arrival (reads) or event time (screens)."""
    columns = [c for c in readings.columns if c != "device_id"]
    best = readings.groupBy("device_id").agg(F.max_by(F.struct(*columns), F.struct(by, "id")).alias("r"))
    return best.select("device_id", "r.*")


def recent(readings: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` newest rows by arrival; at most 1000."""
    if not 1 <= k <= 1000:
        raise ValueError("1 <= k <= 1000")
    return readings.orderBy(F.desc("arrival_us"), F.desc("id")).limit(k)


def history(readings: DataFrame, device: str, k: int = 100) -> DataFrame:
    return recent(readings.where(F.col("device_id") == device), k)


def meters_with_latest(meters: DataFrame, readings: DataFrame) -> DataFrame:
    now = latest(readings).select("device_id", F.col("arrival_us").alias("latest_us"), "voltage", "power", "status")
    return meters.join(now, "device_id", "left")


def with_zone(readings: DataFrame, meters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings of known devices with their registered zone, and those of unknown ones."""
    names = meters.select("device_id", F.col("zone").alias("registered_zone"))
    return readings.join(names, "device_id"), readings.join(names, "device_id", "left_anti")


def power_by_zone_bucket(readings: DataFrame, zones: list[str], now_us: int, span_us: int = 60_000_000, width_us: int = 2_000_000) -> DataFrame:
    """Tumbling buckets of the last span, one column of summed power per known zone; no reading counts as 0."""
    rows = readings.where((F.col("arrival_us") > now_us - span_us) & (F.col("arrival_us") <= now_us))
    bucket = (F.floor(F.col("arrival_us") / width_us) * width_us).cast("long").alias("bucket")
    return rows.groupBy(bucket).pivot("zone", zones).sum("power").fillna(0.0)


def melt(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return rows.unpivot(ids, metrics, "metric", "value")


def tone(status: Column) -> Column:
    return F.when(status.isNull(), "neutral").when(status == "activo", "success").when(status == "mantenimiento", "warning").otherwise("danger")


def liveness(age: Column, live_s: float = 10, delayed_s: float = 30) -> Column:
    return F.when(age.isNull(), "no reading").when(age < live_s, "live").when(age < delayed_s, "delayed").otherwise("no signal")


def shown(number: Column, decimals: int = 3) -> Column:
    """A number as dashboards show it: points between thousands, a comma before decimals, a dash for none."""
    text = F.format_number(number, decimals)
    return F.when(number.isNull() | F.isnan(number), "—").otherwise(F.translate(text, ",.", ".,"))


def health(db: Column, broker: Column, failed: Column) -> Column:
    """What a dashboard shows: down if the request failed, unknown before the first answer, else ok only if both parts are."""
    return F.when(failed, "down").when(db.isNull() | broker.isNull(), "unknown").when(db & broker, "ok").otherwise("down")


def health_of_server(db: Column, broker: Column) -> Column:
    """What the server says of itself: ok only if the database answers and the broker is connected."""
    return F.when(F.coalesce(db & broker, F.lit(False)), "ok").otherwise("degraded")


def labelled_zones(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with a ``label``: the zone's in ``labels`` (zone, label), or the zone itself."""
    return rows.join(labels.select("zone", F.col("label").alias("__label")), "zone", "left").withColumn("label", F.coalesce("__label", "zone")).drop("__label")


def zone_pairs(meters: DataFrame, block: int = 200) -> DataFrame:
    """(za, zb, centroids, nearest) of every pair of zones: the distance of their centroids, and of their closest meters.

    ``meters`` has zone, x and y in one frame. The answer has a row for each pair of zones, so it is for audits of a registry.
    A zone is one row of coordinates; zones lie in blocks of about ``block``, and each pair of blocks is compared by itself,
    one zone against a block at a time.
    """
    place = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y"))
    zones = meters.where("zone is not null").groupBy("zone").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.collect_list(place).alias("at"))
    count = meters.select("zone").distinct().count()
    blocks = max(1, -(-count // block))
    own = F.pmod(F.xxhash64("zone"), F.lit(blocks)).cast("int")
    rows = zones.select("zone", "x", "y", F.col("at.x").alias("xs"), F.col("at.y").alias("ys"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    rows = rows.select("zone", "x", "y", "xs", "ys", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def met(key, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        left, right = (pdf[pdf["own"] == b].reset_index(drop=True) for b in (low, high))
        out, size = [], right["xs"].map(len).to_numpy()
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["za", "zb", "centroids", "nearest"])
        x, y, names = np.concatenate(right["xs"].tolist()), np.concatenate(right["ys"].tolist()), right["zone"].to_numpy(object)
        first, some = (size.cumsum() - size)[size > 0], size > 0
        for z in left.itertuples():
            near, squares = np.full(len(right), np.nan), np.full(len(x), np.inf)
            for at in range(0, len(z.xs), 64):
                dx, dy = z.xs[at : at + 64, None] - x, z.ys[at : at + 64, None] - y
                squares = np.minimum(squares, (dx * dx + dy * dy).min(0))
            if len(z.xs) and len(x):
                near[some] = np.sqrt(np.minimum.reduceat(squares, first))
            take = names > z.zone if low == high else np.ones(len(right), bool)
            dx, dy = z.x - right["x"].to_numpy(float), z.y - right["y"].to_numpy(float)
            turn = names < z.zone
            out.append(pd.DataFrame({"za": np.where(turn, names, z.zone), "zb": np.where(turn, z.zone, names), "centroids": np.sqrt(dx * dx + dy * dy), "nearest": near})[take])
        return pd.concat(out)

    return spread(rows, "low", "high").groupBy("low", "high").applyInPandas(met, "za string, zb string, centroids double, nearest double")
