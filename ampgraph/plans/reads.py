"""Queries by the operators of ``readings``; their SQL twins are texts of ``relational``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, graph, readings, registry
from .registry import operator
from .views import DAY_US, get


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@operator
def agg_horizon(s, d):
    return readings.horizon(get(s, d, "telemetry"))


@operator
def agg_spatial_sigma(s, d):
    return _rounded(readings.spatial_sigma(get(s, d, "telemetry"), "voltage", DAY_US), 6, "meters_per_instant", "mean", "sigma")


@operator
def agg_profile_assemble(s, d):
    rows = readings.profile(get(s, d, "telemetry"), ["voltage", "current", "power"])
    return _rounded(_rounded(rows, 6, "mean", "sigma"), 3, "least", "most")


@operator
def agg_zone_type(s, d):
    return readings.meters_by(get(s, d, "telemetry"), "zone", "device_type")


@operator
def agg_registry_by_zone(s, d):
    return get(s, d, "meters").where("active AND zone IS NOT NULL").groupBy("zone").agg(F.count(F.lit(1)).alias("meters"))


@operator
def agg_seen_by_zone(s, d):
    t = get(s, d, "telemetry")
    return readings.meters_by(readings.within(t, readings.horizon(t, 48)), "zone", name="seen")


@operator
def agg_bins(s, d):
    return readings.bins(get(s, d, "cells"))


@operator
def agg_zone_counts(s, d):
    return readings.zone_counts(get(s, d, "meters"))


@operator
def agg_ingest_rate(s, d):
    return readings.arrival_rate(get(s, d, "telemetry"), "zone")


@operator
def agg_msg_rate(s, d):
    return readings.message_rate(get(s, d, "telemetry"), "zone")


@operator
def agg_active_10s(s, d):
    rows = readings.with_now(get(s, d, "meters"), get(s, d, "telemetry"))
    return rows.agg(F.count_if((F.col("now") - F.col("last_seen_us")) / 1e6 < 86_400).alias("active"))


@operator
def agg_newest(s, d):
    return get(s, d, "telemetry").orderBy(F.desc("ts_us"), "id").limit(1).select("id", "device_id", "ts_us")


@operator
def agg_group_mean(s, d):
    values = ["voltage", "power", "energy"]
    return _rounded(readings.means(get(s, d, "telemetry"), values, "status"), 6, *values)


@operator
def agg_mean_by_key(s, d):
    values = ["current", "frequency"]
    return _rounded(readings.means(get(s, d, "telemetry"), values, "node"), 6, *values)


@operator
def agg_mean_by_pair(s, d):
    values = ["power", "voltage"]
    return _rounded(readings.means(get(s, d, "telemetry"), values, "node", "device_type"), 6, *values)


@operator
def agg_zone_bbox_density(s, d):
    return _rounded(readings.box_density(get(s, d, "points")), 6, "density")


@operator
def agg_zone_diameter(s, d):
    return get(s, d, "pairs").groupBy("zone").agg(F.round(F.max("dist"), 6).alias("diameter"))


@operator
def agg_corr(s, d):
    return get(s, d, "telemetry").groupBy("zone").agg(F.round(F.corr("voltage", "power"), 6).alias("c"))


def _curve(s, d):
    return readings.curve(get(s, d, "cells"))


@operator
def win_episode_edges(s, d):
    return readings.edges_of_episodes(_curve(s, d).select("zone", "bin", (F.col("y") > 50).alias("above")))


@operator
def win_sign_crossings(s, d):
    return readings.crossings(_curve(s, d).select("zone", "bin", (F.col("y") > 50).alias("above")))


@operator
def win_local_extrema(s, d):
    return readings.extrema(_curve(s, d))


@operator
def win_log_gradient(s, d):
    place = F.row_number().over(Window.partitionBy("zone").orderBy("bin")).cast("double")
    return _rounded(readings.log_gradient(_curve(s, d).withColumn("x", place)), 6, "gradient")


@operator
def prj_age_seconds(s, d):
    rows = readings.with_now(get(s, d, "meters"), get(s, d, "telemetry"))
    return rows.select("device_id", readings.age_seconds(F.col("last_seen_us"), F.col("now")).alias("age"))


@operator
def prj_freshness(s, d):
    t = get(s, d, "telemetry")
    rows = readings.with_now(t.groupBy("zone").agg(F.max("arrival_us").alias("last")), t)
    return rows.select("zone", F.when(readings.age_seconds(F.col("last"), F.col("now")) > 60, "stale").otherwise("live").alias("freshness"))


@operator
def sc_relative_spread(s, d):
    return _rounded(readings.relative_spread(get(s, d, "telemetry"), "voltage", "device_type"), 9, "spread")


@operator
def sc_zscore(s, d):
    return _rounded(readings.zscores(get(s, d, "signal")), 6, "z")


@operator
def gr_khop_sizes(s, d):
    return get(s, d, "balls").select("zone", "radius", "centre", "size")


@operator
def jn_pairwise_self(s, d):
    return _rounded(graph.pairs(get(s, d, "points")).where("src < dst"), 6, "dist")


@operator
def set_concat(s, d):
    t = get(s, d, "telemetry").select("id", "value", "zone")
    return t.where("zone = 'z000001'").unionByName(t.where("zone = 'z000002'")).drop("zone")


@operator
def srt_top2(s, d):
    best = Window.partitionBy("zone").orderBy(F.desc("value"), "id")
    return get(s, d, "telemetry").withColumn("r", F.row_number().over(best)).where("r <= 2").select("zone", "device_id", "value")


@operator
def jn_device_zone(s, d):
    known, _ = _registered(s, d)
    return known.groupBy(F.col("registered_zone").alias("zone")).agg(F.count(F.lit(1)).alias("known"))


def _registered(s, d):
    return registry.with_zone(get(s, d, "telemetry"), get(s, d, "meters").where("active"))


@operator
def agg_last_hour(s, d):
    rows = registry.recent(get(s, d, "telemetry"), 1000)
    return readings.with_now(rows, get(s, d, "telemetry")).agg(F.count_if(F.col("arrival_us") >= F.col("now") - readings.HOUR_US).alias("n"))


@operator
def flt_fresh_window(s, d):
    t = get(s, d, "telemetry")
    return readings.with_now(t, t).where(F.col("arrival_us") >= F.col("now") - DAY_US).select("id", "device_id")


@operator
def jn_silent_anti(s, d):
    return readings.silent(get(s, d, "meters"), get(s, d, "telemetry"), DAY_US).groupBy("zone").agg(F.count(F.lit(1)).alias("silent"))


@operator
def prj_rest_telemetry(s, d):
    return readings.renamed(get(s, d, "telemetry"), readings.TELEMETRY_NAMES)


@operator
def prj_rest_meters(s, d):
    return readings.renamed(get(s, d, "meters"), readings.METER_NAMES)


@operator
def prj_status_label(s, d):
    return get(s, d, "telemetry").select("id", readings.status_label(F.col("status")).alias("label"))


@operator
def prj_device_type(s, d):
    return get(s, d, "meters").select("device_id", readings.kind_of(F.col("device_id")).alias("kind"))


@operator
def flt_active_meters(s, d):
    return get(s, d, "meters").where("active").select("device_id", "zone")


@operator
def flt_bounds(s, d):
    return get(s, d, "telemetry").select("id", "voltage", (~F.col("voltage").between(205, 235)).alias("outside"))


@operator
def jn_zone_type_profile(s, d):
    sigma = readings.profile(get(s, d, "telemetry"), ["voltage"]).select("device_type", F.round("sigma", 6).alias("sigma"))
    return get(s, d, "meters").join(sigma, "device_type").select("device_id", "zone", "sigma")


@operator
def agg_mean_optional(s, d):
    return get(s, d, "telemetry").groupBy("zone").agg(F.round(F.avg("energy"), 6).alias("energy"), F.count("energy").alias("filled"))


@operator
def srt_table_20(s, d):
    return get(s, d, "telemetry").orderBy(F.desc("ts_us"), F.desc("id")).limit(20).select("id", "status")


@operator
def set_unknown_zones(s, d):
    wanted = s.createDataFrame([("z000000",), ("nowhere",), ("z999999",)], "zone string")
    return readings.unknown(wanted, get(s, d, "meters"))


@operator
def sc_mad_threshold(s, d):
    return _rounded(evaluate.mad_thresholds(get(s, d, "signal"), "value", "zone"), 6, "cut")
