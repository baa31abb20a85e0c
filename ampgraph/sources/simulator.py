"""Synthetic readings: a daily load curve with noise, clamped, with derived power and integrated energy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ten zones in the order in which meters are dealt to them.
ZONE_CYCLE = ("a", "b", "c", "a", "d", "e", "a", "f", "b", "c")


def daily_load(ts: Column) -> Column:
    """sin(2 pi (hour - 13) / 24) with a fractional hour of the UTC day."""
    hour = F.pmod(F.unix_micros(ts), F.lit(86_400_000_000)) / F.lit(3.6e9)
    return F.sin(F.lit(2 * math.pi) * (hour - 13) / F.lit(24.0))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def simulate(spark: SparkSession, meters: int, seconds: int, step: int, seed: int = 0, start: str = "2026-01-01 00:00:00") -> DataFrame:
    """One row per meter and step; Gaussian draws are seeded per row, energy is the running integral of power."""
    grid = spark.range(meters).select((F.col("id") + 1).alias("meter"), F.explode(F.sequence(F.lit(0), F.lit(seconds - 1), F.lit(step))).alias("at"))
    ts = F.lit(start).cast("timestamp") + F.make_dt_interval(secs=F.col("at"))
    rows = grid.withColumn("ts", ts)
    voltage = clamp(F.lit(220.0) + F.randn(seed) * 1.5, 187.0, 253.0)
    current = clamp(F.lit(12.0) + daily_load(F.col("ts")) * 6.0 + F.randn(seed + 1) * 0.8, 0.0, 60.0)
    rows = rows.withColumns({"voltage": F.bround(voltage, 2), "current": F.bround(current, 3), "power_factor": F.bround(clamp(F.lit(0.95) + F.randn(seed + 2) * 0.02, 0.0, 1.0), 3)})
    rows = rows.withColumn("power", F.bround(F.col("voltage") * F.col("current") * F.col("power_factor") / 1000, 6))
    run = Window.partitionBy("meter").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    zone = F.element_at(F.array(*map(F.lit, ZONE_CYCLE)), (F.pmod(F.col("meter") - 1, F.lit(len(ZONE_CYCLE))) + 1).cast("int"))
    return rows.select(F.format_string("dev-%05d", "meter").alias("device_id"), zone.alias("zone"), "ts", "voltage", "current", "power", "power_factor", F.bround(F.sum(F.col("power") * step / 3600).over(run), 6).alias("energy"))


def replay_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of JSON messages as a stream, a few files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def rate_stream(spark: SparkSession, meters: int, rows_per_second: int = 10) -> DataFrame:
    """A live stream of simulated readings, for tests and load."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    meter = F.pmod(F.col("value"), F.lit(meters)) + 1
    return rate.select(F.format_string("dev-%05d", meter).alias("device_id"), F.col("timestamp").alias("ts"), (F.lit(220.0) + daily_load(F.col("timestamp"))).alias("voltage"))
