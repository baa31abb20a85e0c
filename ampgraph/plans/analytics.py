"""Queries built from the library's operators, with SQL twins written apart."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import detect, evaluate, graph, inject, readings, registry, spectral, windows
from ..settings import cycle_interval, zone_filter
from ..sources import simulator, sinks, tables
from ..storage import materialize
from .registry import ORACLE, QUERIES, operator, query
from .views import DAY_US, FULL, GAPPY, LENGTH, SIGMA, THRESHOLD, get

__all__ = ["ORACLE", "QUERIES"]

PLACES = "SELECT *, row_number() OVER (PARTITION BY zone, bin ORDER BY round(statistic, 9) DESC, radius, centre) AS place FROM scores"

WINNERS = f"""
SELECT zone, bin, statistic > {THRESHOLD}e0 AS detected, statistic, candidates, CASE WHEN statistic > {THRESHOLD}e0 THEN radius END AS radius,
  CASE WHEN statistic > {THRESHOLD}e0 THEN centre END AS centre, CASE WHEN statistic > {THRESHOLD}e0 THEN size END AS size
FROM (SELECT *, count(*) OVER (PARTITION BY zone, bin) AS candidates FROM places) WHERE place = 1"""


def _whole(s, d):
    """The signal's complete instants, which kernels over eigenvectors need."""
    return spectral.complete(get(s, d, "signal"), get(s, d, "points"))


def r9(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- sources and sinks ---


@query("SELECT device_id, zone, lat, lon FROM meters WHERE coalesce(active, TRUE)")
def src_meters(s, d):
    return tables.load_meters(get(s, d, "meters")).select("device_id", "zone", "lat", "lon")


@query("SELECT device_id, zone FROM meters WHERE device_id NOT LIKE '%5'")
def src_meters_complete(s, d):
    holes = get(s, d, "meters").withColumn("lat", F.when(~F.col("device_id").endswith("5"), F.col("lat")))
    return tables.load_meters(holes, only_active=False, skip_incomplete=True).select("device_id", "zone")


@query("SELECT device_id, zone AS zona, lat, lon FROM meters")
def src_topology_json(s, d):
    rows = get(s, d, "meters").select("zone", F.struct("device_id", F.col("zone").alias("zona"), "lat", "lon").alias("m"))
    documents = rows.groupBy("zone").agg(F.to_json(F.struct(F.collect_list("m").alias("meters"))).alias("value"))
    return tables.parse_topology(documents)


@query("SELECT * FROM (VALUES ('voltaje_v', 'tri', 'media', 220.5e0), ('voltaje_v', 'mono', 'media', 219e0), ('voltaje_v', 'mono', 'p99', 240e0)) AS t(magnitude, device_type, stat, value)")
def src_profile_json(s, d):
    doc = '{"magnitudes": {"voltaje_v": {"tri": {"media": 220.5}, "mono": {"media": 219, "p99": 240}}}}'
    return tables.parse_profile(s.createDataFrame([(doc,)], "value string"))


@query("SELECT * FROM (VALUES ('voltaje_v', 187e0, 253e0), ('corriente_a', 0e0, 60e0)) AS t(magnitude, minimum, maximum)")
def src_bounds_json(s, d):
    doc = '{"properties": {"voltaje_v": {"minimum": 187, "maximum": 253}, "corriente_a": {"minimum": 0, "maximum": 60}, "estado": {"type": "string"}}}'
    return tables.parse_bounds(s.createDataFrame([(doc,)], "value string"))


@query("SELECT * FROM (VALUES ('voltaje_v', 'a', 4.4e0, 16), ('voltaje_v', 'b', 4.5e0, 16)) AS t(magnitude, zone, threshold, n_meters)")
def src_calibration_json(s, d):
    zone = '"{0}": {{"zone": "{0}", "threshold": {1}, "n_meters": 16}}'
    doc = '{"format": "ampgraph-calibration-v1", "magnitude": "voltaje_v", "zones": {' + zone.format("a", 4.4) + ", " + zone.format("b", 4.5) + "}}"
    return tables.parse_calibration(s.createDataFrame([(doc,)], "value string"), "ampgraph-calibration-v1").select("magnitude", "zone", "threshold", "n_meters")


@query()
def src_simulator(s, d):
    return simulator.simulate(s, meters=20, seconds=600, step=60, seed=7)


@query()
def src_null_signal(s, d):
    return inject.null_signal(get(s, d, "points"), instants=8, mean=220.0, sigma=1.5, seed=3)


@query("""
SELECT device_id, max_by(device_type, id) FILTER (WHERE device_type IS NOT NULL) AS device_type, max_by(zone, id) AS zone,
  max_by(node, id) FILTER (WHERE node IS NOT NULL) AS node, max_by(arrival_us, id) AS last_seen_us, TRUE AS active
FROM (SELECT id, device_id, zone, arrival_us, CASE WHEN id % 3 <> 0 THEN device_type END AS device_type, CASE WHEN id % 5 = 0 THEN node END AS node FROM telemetry) GROUP BY device_id""")
def snk_upsert_meter(s, d):
    rows = get(s, d, "telemetry").withColumns({"device_type": F.when(F.col("id") % 3 != 0, F.col("device_type")), "node": F.when(F.col("id") % 5 == 0, F.col("node"))})
    return registry.upsert(rows)


STATUS = f"""
SELECT zone, bin, CASE WHEN incomplete = 0 THEN 'ventana' ELSE 'sin_datos' END AS status, incomplete,
  CASE WHEN incomplete = 0 THEN NULL WHEN bin - {LENGTH - 1} < first THEN 'calentamiento' ELSE 'bins_incompletos' END AS reason
FROM (SELECT zone, bin, {LENGTH} - sum(complete) OVER (PARTITION BY zone ORDER BY bin ROWS {LENGTH - 1} PRECEDING) AS incomplete, min(bin) OVER (PARTITION BY zone) AS first
  FROM (SELECT g.zone, g.bin, CASE WHEN coalesce(s.present, 0) = z.n THEN 1 ELSE 0 END AS complete
    FROM (SELECT zone, unnest(generate_series(min(bin), max(bin))) AS bin FROM cells GROUP BY zone) g
    LEFT JOIN (SELECT zone, bin, count(*) AS present FROM cells GROUP BY zone, bin) s USING (zone, bin)
    JOIN (SELECT zone, count(*) AS n FROM meters GROUP BY zone) z USING (zone)))"""


def _status(s, d):
    return windows.window_status(get(s, d, "cells"), windows.zone_sizes(get(s, d, "meters")), LENGTH)


@query("SELECT zone, bin, status, incomplete::BIGINT AS incomplete, reason FROM statuses", statuses=STATUS)
def st_incomplete_reason(s, d):
    return _status(s, d)


@query("SELECT zone, count(*) FILTER (WHERE status = 'ventana') AS windows, count(*) FILTER (WHERE status = 'sin_datos') AS missing FROM statuses GROUP BY zone", statuses=STATUS)
def st_zone_result(s, d):
    return _status(s, d).groupBy("zone").agg(F.count_if(F.col("status") == "ventana").alias("windows"), F.count_if(F.col("status") == "sin_datos").alias("missing"))


@query("""
SELECT zone, bin, topic FROM (SELECT zone, bin, unnest(CASE WHEN status = 'ventana' THEN ['net/ventana/' || zone, 'net/deteccion/' || zone] ELSE ['net/sin-ventana/' || zone] END) AS topic FROM statuses)""", statuses=STATUS)
def snk_publish(s, d):
    return sinks.dispatch(_status(s, d), "net").select("zone", "bin", "topic")


@query("""
SELECT 'net/' || CASE WHEN status = 'ventana' THEN kind ELSE 'sin-ventana' END || '/' || zone AS topic,
  '{"zone":"' || zone || '","bin":' || bin || ',"status":"' || status || '","incomplete":' || incomplete::BIGINT || CASE WHEN reason IS NULL THEN '' ELSE ',"reason":"' || reason || '"' END || '}' AS value
FROM statuses, (VALUES ('ventana'), ('deteccion')) AS k(kind) WHERE status = 'ventana' OR kind = 'ventana'""", statuses=STATUS)
def snk_encode(s, d):
    return sinks.encode(sinks.dispatch(_status(s, d), "net"), "topic")


def _payload_parts(s, d):
    """What bodies are made of: means, the ranking, detections and each zone's provenance."""
    origin = inject.fingerprints(get(s, d, "points"), get(s, d, "edges"))
    origin = origin.select("zone", F.lit("voltage").alias("magnitude"), F.lit("meters").alias("topology"), F.lit("telemetry").alias("profile"), "fingerprint", F.lit("fixed").alias("threshold_source"), F.lit(THRESHOLD).alias("threshold"), F.lit(SIGMA).alias("sigma"), F.lit(LENGTH).alias("window"), F.lit(FULL).alias("bin_us"))
    return get(s, d, "means"), detect.ranking(get(s, d, "scores")), _detections(s, d), origin


def _payloads(s, d):
    return sinks.window_payload(*_payload_parts(s, d), (F.col("bin") + 1) * FULL, top_k=5)


_BODY = "version int, bin long, emitted_us long, nodes array<struct<idx:long,mean:double>>, detection struct<detected:boolean,statistic:double,candidates:long>, ranking array<struct<place:long,radius:int,centre:long,size:long,statistic:double>>, provenance struct<magnitude:string,fingerprint:string,threshold:double,sigma:double,window:int,bin_us:long>"


@query(f"""
SELECT m.zone, m.bin, 1 AS version, (m.bin + 1) * {FULL} AS emitted_us, m.nodes, m.mean, w.detected, round(w.statistic, 6) AS statistic, least(5, w.candidates) AS places, p.strongest, {THRESHOLD}e0 AS threshold, {LENGTH} AS "window", 32 AS digits
FROM (SELECT zone, bin, count(*) AS nodes, round(avg(mean), 6) AS mean FROM means GROUP BY zone, bin) m
JOIN winners w USING (zone, bin) JOIN (SELECT zone, bin, centre AS strongest FROM places WHERE place = 1) p USING (zone, bin)""", winners=WINNERS, places=PLACES)
def st_payload_window(s, d):
    """The bodies as a reader of the topic sees them."""
    b = _payloads(s, d).select("zone", F.from_json("value", _BODY).alias("b")).select("zone", "b.*")
    total = F.aggregate("nodes", F.lit(0.0), lambda acc, x: acc + x["mean"])
    return b.select(
        "zone", "bin", "version", "emitted_us", F.size("nodes").cast("long").alias("nodes"), F.round(total / F.size("nodes"), 6).alias("mean"), "detection.detected", F.round("detection.statistic", 6).alias("statistic"),
        F.size("ranking").cast("long").alias("places"), F.col("ranking")[0]["centre"].alias("strongest"), "provenance.threshold", "provenance.window", F.length("provenance.fingerprint").alias("digits"),
    )


@query("""
SELECT zone, '{"version":1,"bin":' || bin || ',"reason":"' || reason || '","incomplete":' || incomplete::BIGINT || coalesce(',"missing":[' || missing || ']', '') || ',"threshold_source":"fixed"}' AS value
FROM statuses LEFT JOIN (
  SELECT zone, bin, string_agg('"' || device_id || '"', ',' ORDER BY device_id) AS missing FROM (SELECT zone, unnest(generate_series(min(bin), max(bin))) AS bin FROM cells GROUP BY zone) g JOIN (SELECT zone, device_id FROM meters) m USING (zone)
  WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.zone = g.zone AND c.bin = g.bin AND c.device_id = m.device_id) GROUP BY zone, bin) USING (zone, bin)
WHERE status = 'sin_datos'""", statuses=STATUS)
def st_payload_missing(s, d):
    gaps = windows.missing_cells(get(s, d, "cells"), get(s, d, "meters")).groupBy("zone", "bin").agg(F.array_sort(F.collect_list("device_id")).alias("missing"))
    return sinks.missing_payload(_status(s, d), gaps, "fixed")


# --- validation ---


def _messages(s, d):
    t = get(s, d, "telemetry")
    stamp = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    body = F.to_json(F.struct("device_id", F.when(F.col("id") % 13 != 0, F.concat(stamp, F.lit("Z"))).otherwise(stamp).alias("timestamp_utc"), "voltage", "current", F.when(F.col("id") % 17 != 0, F.col("power")).alias("power"), "frequency", "power_factor"))
    broken = F.when(F.col("id") % 19 == 0, F.concat(F.lit("{"), body)).otherwise(body)
    return registry.parse_messages(t.select("id", broken.alias("value")).withColumn("value", F.col("value"))), t


@query("SELECT count(*) AS n, count(*) FILTER (WHERE id % 13 <> 0 AND id % 17 <> 0 AND id % 19 <> 0) AS valid FROM telemetry")
def flt_valid_payload(s, d):
    rows, _ = _messages(s, d)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(registry.valid_message()).alias("valid"))


@query("SELECT id, voltage BETWEEN 187 AND 253 AND current BETWEEN 0 AND 60 AND power BETWEEN 0 AND 30 AND frequency BETWEEN 57 AND 63 AND power_factor BETWEEN 0 AND 1 AND coalesce(status IN ('activo', 'mantenimiento', 'falla', 'corte'), FALSE) AS ok FROM telemetry")
def flt_payload_schema(s, d):
    known = F.coalesce(F.col("status").isin("activo", "mantenimiento", "falla", "corte"), F.lit(False))
    return get(s, d, "telemetry").select("id", (registry.in_ranges() & known).alias("ok"))


@query("SELECT id, voltage - 100 BETWEEN 100 AND 130 AND current BETWEEN 0 AND 50 AND frequency BETWEEN 59.5 AND 60.5 AND power_factor BETWEEN 0 AND 1 AS ok FROM telemetry")
def flt_legacy_payload(s, d):
    rows = get(s, d, "telemetry").withColumn("voltage", F.col("voltage") - 100)
    return rows.select("id", registry.in_ranges(registry.LEGACY_RANGES).alias("ok"))


@query("SELECT count(*) FILTER (WHERE id % 13 = 0 AND id % 19 <> 0) AS naive FROM telemetry")
def flt_tz_aware(s, d):
    rows, _ = _messages(s, d)
    return rows.agg(F.count_if(F.col("timestamp_utc").isNotNull() & ~F.col("timestamp_utc").rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")).alias("naive"))


@query("SELECT device_id, lat * 20 BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND length(zone) > 0 AS ok FROM meters")
def flt_meter_valid(s, d):
    return get(s, d, "meters").withColumn("lat", F.col("lat") * 20).select("device_id", registry.valid_coordinates().alias("ok"))


@query("SELECT count(*) AS cells, count(DISTINCT (zone, t)) AS instants, count(*) FILTER (WHERE isnan(value) OR isinf(value)) AS broken FROM signal")
def flt_signal_matrix(s, d):
    return get(s, d, "signal").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("zone", "t").alias("instants"), F.count_if(~registry.finite(F.col("value"))).alias("broken"))


# --- joins and reads ---


@query("""
SELECT m.device_id, m.zone, l.arrival_us AS latest_us, l.voltage, l.power, l.status FROM meters m LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY arrival_us DESC, id DESC) AS r FROM telemetry) l ON m.device_id = l.device_id AND l.r = 1""")
def jn_meters_latest(s, d):
    return registry.meters_with_latest(get(s, d, "meters").select("device_id", "zone"), get(s, d, "telemetry"))


@query("SELECT zone, src, dst, round(dist, 6) AS dist FROM pairs WHERE dist <= 2000")
def jn_radius_theta(s, d):
    return r6(graph.near_pairs(get(s, d, "points"), 2000.0), "dist")


@query("SELECT zone, src, dst, round(dist, 6) AS dist FROM knn")
def jn_knn(s, d):
    return r6(graph.nearest_in_rings(get(s, d, "points"), 4)[0], "dist")


@query("""
SELECT a.zone, a.start, a.start + 3 AS stop, e.event FROM (SELECT zone, bin AS start FROM cells GROUP BY zone, bin) a
JOIN (SELECT zone, min(bin) + 2 AS start, min(bin) + 4 AS stop, 1 AS event FROM cells GROUP BY zone) e ON a.zone = e.zone AND a.start < e.stop AND a.start + 3 > e.start""")
def jn_overlap(s, d):
    c = get(s, d, "cells")
    found = c.select("zone", F.col("bin").alias("start")).distinct().withColumn("stop", F.col("start") + 3)
    events = c.groupBy("zone").agg((F.min("bin") + 2).alias("start"), (F.min("bin") + 4).alias("stop")).withColumn("event", F.lit(1))
    return evaluate.overlaps(found, events)


@query("SELECT zone, centre, idx FROM ball2")
def jn_khop(s, d):
    return graph.k_hop(get(s, d, "edges"), get(s, d, "points"), 2)


@query("SELECT zone, centre, idx FROM ball1")
def gr_khop(s, d):
    return graph.k_hop(get(s, d, "edges"), get(s, d, "points"), 1)


@query("SELECT b.zone, b.radius, b.centre, b.n - b.size AS outside FROM balls b")
def jn_ball_complement(s, d):
    return get(s, d, "balls").select("zone", "radius", "centre", (F.col("n") - F.col("size")).alias("outside"))


# --- aggregations and windows ---


@query("SELECT g.zone, g.bin, coalesce(s.present, 0) AS present FROM (SELECT zone, unnest(generate_series(min(bin), max(bin))) AS bin FROM rare GROUP BY zone) g LEFT JOIN (SELECT zone, bin, count(*) AS present FROM rare GROUP BY zone, bin) s USING (zone, bin)", rare="SELECT * FROM cells WHERE bin % 3 = 0")
def agg_dense_series(s, d):
    return windows.completeness(get(s, d, "cells").where("bin % 3 = 0"), windows.zone_sizes(get(s, d, "meters"))).select("zone", "bin", "present")


@query("""
SELECT (arrival_us // 86400000000) * 86400000000 AS bucket, coalesce(sum(power) FILTER (WHERE zone = 'z000000'), 0e0) AS z000000, coalesce(sum(power) FILTER (WHERE zone = 'z000001'), 0e0) AS z000001
FROM telemetry WHERE arrival_us > (SELECT max(arrival_us) FROM telemetry) - 864000000000 GROUP BY bucket""".replace("coalesce(sum", "round(coalesce(sum").replace(", 0e0)", ", 0e0), 6)"))
def agg_power_by_zone_bucket(s, d):
    t = get(s, d, "telemetry")
    now = t.agg(F.max("arrival_us")).first()[0]
    return r6(registry.power_by_zone_bucket(t, ["z000000", "z000001"], now, 10 * DAY_US, DAY_US), "z000000", "z000001")


CONFUSION = "SELECT status, value > 30 AS predicted, voltage > 215 AS truth FROM telemetry"


@query("""
SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS precision,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0e0 END AS fpr, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0e0 END AS f1
FROM (SELECT status, count(*) FILTER (WHERE predicted AND truth) AS tp, count(*) FILTER (WHERE predicted AND NOT truth) AS fp, count(*) FILTER (WHERE NOT predicted AND truth) AS fn, count(*) FILTER (WHERE NOT predicted AND NOT truth) AS tn FROM marks GROUP BY status)""", marks=CONFUSION)
def agg_confusion(s, d):
    return evaluate.confusion(get(s, d, "telemetry").select("status", (F.col("value") > 30).alias("predicted"), (F.col("voltage") > 215).alias("truth")), "status")


@query("""
SELECT zone, count(*) AS hours, round(avg(fired), 6) AS fired_mean, round(quantile_cont(fired, 0.95), 6) AS fired_p95, max(fired) AS fired_most, round(avg(episodes), 6) AS episodes_mean,
  round(quantile_cont(episodes, 0.95), 6) AS episodes_p95, max(episodes) AS episodes_most, round(sum(fired) / sum(windows), 6) AS share
FROM (SELECT zone, hour, count(*) AS windows, count(*) FILTER (WHERE fired) AS fired, count(*) FILTER (WHERE fired AND NOT before) AS episodes
  FROM (SELECT *, coalesce(lag(fired) OVER (PARTITION BY zone, hour ORDER BY t), FALSE) AS before FROM (SELECT zone, bin AS t, bin // 4 AS hour, avg(value) > 50 AS fired FROM cells GROUP BY zone, bin)) GROUP BY zone, hour) GROUP BY zone""")
def agg_false_alarm_rate(s, d):
    """An "hour" of four bins, as the tables' bins are days long."""
    flags = get(s, d, "cells").groupBy("zone", F.col("bin").alias("t")).agg((F.avg("value") > 50).alias("fired"))
    return r6(evaluate.false_alarms(flags, 4), "fired_mean", "fired_p95", "episodes_mean", "episodes_p95", "share")


@query("SELECT zone, count(*) FILTER (WHERE status = 'ventana') / count(*) AS fraction FROM statuses WHERE reason IS NULL OR reason <> 'calentamiento' GROUP BY zone", statuses=STATUS)
def win_complete_runs(s, d):
    rows = _status(s, d).where("reason IS NULL OR reason <> 'calentamiento'")
    return rows.groupBy("zone").agg((F.count_if(F.col("status") == "ventana") / F.count(F.lit(1))).alias("fraction"))


@query("SELECT unnest(generate_series(0, 84, 4)) AS start")
def win_sliding_index(s, d):
    return s.createDataFrame([(x,) for x in windows.window_starts(100, 16, 4)], "start long")


@query("SELECT zone, bin, idx, round(mean, 6) AS mean FROM means")
def win_sliding_mean(s, d):
    return r6(get(s, d, "means"), "mean")


@query("SELECT zone, bin, round(min(mean), 6) AS low, round(max(mean), 6) AS high, count(*) AS nodes FROM means GROUP BY zone, bin")
def st_dense_window(s, d):
    """What a window's dense vector holds: as many means as the zone has nodes."""
    rows = get(s, d, "means").groupBy("zone", "bin").agg(F.min("mean").alias("low"), F.max("mean").alias("high"), F.count(F.lit(1)).alias("nodes"))
    return r6(rows, "low", "high")




@query("SELECT zone, bin, radius, centre, size, round(statistic, 6) AS statistic, place FROM places", places=PLACES)
def win_ranking(s, d):
    return r6(detect.ranking(get(s, d, "scores")), "statistic")


@query("SELECT zone, bin, radius, centre, place FROM places WHERE place <= 5", places=PLACES)
def srt_top_k_ranking(s, d):
    return detect.ranking(get(s, d, "scores")).where("place <= 5").select("zone", "bin", "radius", "centre", "place")


@query("SELECT id, 'voltage' AS metric, voltage AS value FROM telemetry UNION ALL SELECT id, 'current', current FROM telemetry UNION ALL SELECT id, 'power', power FROM telemetry")
def rsh_melt(s, d):
    return registry.melt(get(s, d, "telemetry"), ["id"], ["voltage", "current", "power"])


@query("SELECT zone, src, dst, round(dist, 6) AS dist FROM edges")
def set_symmetrize_union(s, d):
    return r6(graph.symmetric(graph.nearest(get(s, d, "pairs"), 4)), "dist")


MUTUAL = "SELECT a.zone, a.src, a.dst, a.dist FROM knn a JOIN knn b ON a.zone = b.zone AND a.src = b.dst AND a.dst = b.src"


@query("SELECT zone, src, dst, round(dist, 6) AS dist FROM mutual_knn", mutual_knn=MUTUAL)
def set_symmetrize_mutual(s, d):
    return r6(graph.symmetric(graph.nearest(get(s, d, "pairs"), 4), mutual=True), "dist")


@query("SELECT zone, radius, centre, size FROM balls")
def set_ball_dedup(s, d):
    return get(s, d, "balls").select("zone", "radius", "centre", "size")


# --- geodesy and text ---


@query("SELECT device_id, round(6378137e0 * (1 - e2) / pow(1 - e2 * q * q, 1.5e0), 4) AS m, round(6378137e0 / sqrt(1 - e2 * q * q), 4) AS n FROM (SELECT device_id, sin(radians(lat)) AS q, (1 / 298.257223563e0) * (2 - 1 / 298.257223563e0) AS e2 FROM meters)")
def geo_curvature_radii(s, d):
    m, n = geo.curvature_radii(F.col("lat"))
    return get(s, d, "meters").select("device_id", F.round(m, 4).alias("m"), F.round(n, 4).alias("n"))


@query("SELECT zone, round(lat0, 9) AS lat0, round(lon0, 9) AS lon0, round(m, 4) AS m, round(n, 4) AS n FROM radii")
def geo_local_frame(s, d):
    f = geo.local_frames(get(s, d, "meters"))
    return f.select("zone", F.round("lat0", 9).alias("lat0"), F.round("lon0", 9).alias("lon0"), F.round("m", 4).alias("m"), F.round("n", 4).alias("n"))


@query("SELECT zone, device_id, round(x, 5) AS x, round(y, 5) AS y FROM points")
def geo_project(s, d):
    return geo.project(get(s, d, "meters")).select("zone", "device_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("SELECT zone, device_id, idx, round(x, 5) AS x, round(y, 5) AS y FROM points")
def geo_project_points(s, d):
    return get(s, d, "points").select("zone", "device_id", "idx", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("SELECT zone, src, dst, round(dist, 5) AS dist FROM pairs UNION ALL SELECT zone, idx, idx, 0e0 FROM points")
def geo_pairwise(s, d):
    own = get(s, d, "points").select("zone", "idx", "idx", F.lit(0.0))
    return get(s, d, "pairs").select("zone", "src", "dst", F.round("dist", 5).alias("dist")).union(own)


@query()
def geo_geodesic(s, d):
    m = get(s, d, "meters").groupBy("zone").agg(F.min(F.struct("device_id", "lat", "lon")).alias("a"), F.max(F.struct("device_id", "lat", "lon")).alias("b"))
    return m.select("zone", geo.geodesic("a.lat", "a.lon", "b.lat", "b.lon").alias("metres"))


@query("SELECT id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp FROM telemetry")
def sc_iso_ms(s, d):
    return get(s, d, "telemetry").select("id", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("stamp"))


@query("SELECT id, strftime(make_timestamp(ts_us), '%H:%M:%S') AS clock FROM telemetry")
def sc_clock(s, d):
    return get(s, d, "telemetry").select("id", F.date_format(F.timestamp_micros("ts_us"), "HH:mm:ss").alias("clock"))


@query("""
SELECT id, CASE WHEN shown IS NULL THEN '—' ELSE regexp_replace(regexp_replace(split_part(shown, '.', 1), '([0-9])([0-9]{3})$', '\\1.\\2'), '([0-9])([0-9]{3})([.]|$)', '\\1.\\2\\3') || ',' || split_part(shown, '.', 2) END AS shown
FROM (SELECT id, format('{:.3f}', energy * 1000) AS shown FROM telemetry)""")
def sc_number(s, d):
    """Three decimals, thousands by points and decimals by a comma; a dash for none."""
    return get(s, d, "telemetry").select("id", registry.shown(F.col("energy") * 1000, 3).alias("shown"))


@query("""
SELECT id, CASE WHEN (h % 2 = 1 AND r > 4) OR (h % 2 = 0 AND r > 5) OR (r = 5 AND h % 2 = 1) THEN (h + 1) / 10e0 ELSE h / 10e0 END AS v1, CASE WHEN q % 10 > 5 OR (q % 10 = 5 AND (q // 10) % 2 = 1) THEN q // 10 + 1 ELSE q // 10 END AS p0
FROM (SELECT id, c // 10 AS h, c % 10 AS r, q FROM (SELECT id, round(voltage * 100)::BIGINT AS c, round(power * 10)::BIGINT AS q FROM telemetry))""")
def sc_round(s, d):
    """Half goes to the even neighbour, ties included: hundredths to tenths, and tenths to units."""
    t = get(s, d, "telemetry")
    cents, tenths = F.round(F.col("voltage") * 100).cast("decimal(12,0)"), F.round(F.col("power") * 10).cast("decimal(12,0)")
    return t.select("id", F.bround((cents / 100).cast("decimal(14,2)"), 1).cast("double").alias("v1"), F.bround((tenths / 10).cast("decimal(14,1)"), 0).cast("long").alias("p0"))


@query()
def sc_zone_key(s, d):
    def keys(it):
        for pdf in it:
            yield pdf.assign(key=[inject.zone_key(z) for z in pdf["zone"]])

    return get(s, d, "meters").select("zone").distinct().mapInPandas(keys, "zone string, key long")


# --- graphs ---


@query("SELECT zone, src, dst, weight FROM edges")
def gr_knn_union(s, d):
    return graph.edges(get(s, d, "points"), graph.GraphConfig("knn_union", 4)).select("zone", "src", "dst", "weight")


@query("SELECT zone, src, dst, 1e0 AS weight FROM mutual_knn", mutual_knn=MUTUAL)
def gr_knn_mutual(s, d):
    return graph.edges(get(s, d, "points"), graph.GraphConfig("knn_mutual", 4)).select("zone", "src", "dst", "weight")


@query("SELECT zone, src, dst, 1e0 AS weight FROM pairs WHERE dist <= 2500")
def gr_radius(s, d):
    return graph.edges(get(s, d, "points"), graph.GraphConfig("radius", radius=2500.0)).select("zone", "src", "dst", "weight")


@query("SELECT zone, src, dst, round(exp(-dist * dist / (2 * 1500e0 * 1500e0)), 9) AS weight FROM edges")
def gr_weights(s, d):
    e = graph.weigh(get(s, d, "edges").drop("weight"), graph.GraphConfig(weights="gaussian", sigma=1500.0))
    return e.select("zone", "src", "dst", F.round("weight", 9).alias("weight"))


@query("SELECT zone, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY dist), 6) AS sigma FROM edges WHERE src < dst GROUP BY zone")
def gr_median_sigma(s, d):
    return r6(graph.median_lengths(get(s, d, "edges")), "sigma")


@query("SELECT e.zone, src, dst, round(exp(-dist * dist / (2 * sigma * sigma)), 9) AS weight FROM edges e JOIN (SELECT zone, percentile_cont(0.5) WITHIN GROUP (ORDER BY dist) AS sigma FROM edges WHERE src < dst GROUP BY zone) USING (zone)")
def gr_adjacency(s, d):
    e = graph.edges(get(s, d, "points"), graph.GraphConfig(weights="gaussian"))
    return e.select("zone", "src", "dst", F.round("weight", 9).alias("weight"))


@query("SELECT zone, count(*) AS edges, round(max(dist), 6) AS longest FROM edges WHERE src < dst AND zone = 'z000000' GROUP BY zone")
def gr_zone(s, d):
    _, e = graph.build(get(s, d, "meters").where("zone = 'z000000'"))
    return e.where("src < dst").groupBy("zone").agg(F.count(F.lit(1)).alias("edges"), F.round(F.max("dist"), 6).alias("longest"))


@query("SELECT zone, count(*) AS edges FROM edges WHERE src < dst GROUP BY zone")
def gr_ami(s, d):
    _, e = graph.build(get(s, d, "meters"))
    return e.where("src < dst").groupBy("zone").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT zone, count(*) AS meters FROM meters WHERE coalesce(active, TRUE) GROUP BY zone")
def gr_load(s, d):
    p, _ = graph.build(tables.load_meters(get(s, d, "meters")))
    return p.groupBy("zone").agg(F.count(F.lit(1)).alias("meters"))


@query("""
WITH RECURSIVE reach(zone, idx, root) AS (SELECT zone, idx, idx FROM points UNION SELECT r.zone, e.dst, r.root FROM reach r JOIN edges e ON e.zone = r.zone AND e.src = r.idx)
SELECT zone, n_meters, degree_min, degree_max, round(degree_mean, 6) AS degree_mean, n_edges, round(longest, 6) AS longest, components, isolated
FROM (SELECT zone, count(*) AS n_meters, min(degree) AS degree_min, max(degree) AS degree_max, avg(degree) AS degree_mean FROM degrees GROUP BY zone)
JOIN (SELECT zone, count(*) AS n_edges, max(dist) AS longest FROM edges WHERE src < dst GROUP BY zone) USING (zone)
JOIN (SELECT zone, count(DISTINCT root) AS components, count(*) FILTER (WHERE alone) AS isolated FROM (SELECT zone, idx, min(root) AS root, count(*) = 1 AS alone FROM reach GROUP BY zone, idx) GROUP BY zone) USING (zone)""")
def gr_stats(s, d):
    return r6(graph.stats(get(s, d, "points"), get(s, d, "edges")), "degree_mean", "longest")


@query("SELECT zone, src, dst, 'asymmetric' AS reason FROM knn a WHERE NOT EXISTS (SELECT 1 FROM knn b WHERE b.zone = a.zone AND b.src = a.dst AND b.dst = a.src)")
def gr_validate_adj(s, d):
    directed = graph.nearest(get(s, d, "pairs"), 4).withColumn("weight", F.lit(1.0))
    return graph.invalid_edges(directed).select("zone", "src", "dst", "reason")


@query("SELECT zone, idx, device_id FROM points p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.zone = p.zone AND q.src = p.idx AND dist <= 700)")
def gr_isolated(s, d):
    p = get(s, d, "points")
    return graph.isolated(p, graph.near_pairs(p, 700.0)).select("zone", "idx", "device_id")


@query("""
WITH RECURSIVE e AS (SELECT zone, src, dst FROM pairs WHERE dist <= 1500), reach(zone, idx, root) AS (
  SELECT zone, idx, idx FROM points UNION SELECT r.zone, e.dst, r.root FROM reach r JOIN e ON e.zone = r.zone AND e.src = r.idx)
SELECT zone, idx, dense_rank() OVER (PARTITION BY zone ORDER BY root) - 1 AS component FROM (SELECT zone, idx, min(root) AS root FROM reach GROUP BY zone, idx)""")
def gr_components(s, d):
    p = get(s, d, "points")
    return graph.components(graph.near_pairs(p, 1500.0), p)


GROUP = "SELECT zone, idx FROM points WHERE idx % 3 = 0"


@query("SELECT g.zone, count(*) AS nodes, coalesce((SELECT count(*) FROM edges e WHERE e.zone = g.zone AND e.src % 3 = 0 AND e.dst % 3 <> 0), 0) AS cut FROM third g GROUP BY g.zone", third=GROUP)
def gr_boundary(s, d):
    return graph.boundary(get(s, d, "edges"), get(s, d, "points").where("idx % 3 = 0").select("zone", "idx"))


@query("SELECT zone, nodes, cut, cut / nodes AS cut_per_node FROM (SELECT g.zone, count(*) AS nodes, (SELECT count(*) FROM edges e WHERE e.zone = g.zone AND e.src % 3 = 0 AND e.dst % 3 <> 0) AS cut FROM third g GROUP BY g.zone)", third=GROUP)
def gr_cut_stats(s, d):
    b = graph.boundary(get(s, d, "edges"), get(s, d, "points").where("idx % 3 = 0").select("zone", "idx"))
    return b.withColumn("cut_per_node", F.col("cut") / F.col("nodes"))


@query("""
WITH RECURSIVE e AS (SELECT zone, src, dst FROM edges WHERE src % 3 = 0 AND dst % 3 = 0), reach(zone, idx, root) AS (
  SELECT zone, idx, idx FROM third UNION SELECT r.zone, e.dst, r.root FROM reach r JOIN e ON e.zone = r.zone AND e.src = r.idx)
SELECT zone, count(DISTINCT root) = 1 AS connected FROM (SELECT zone, idx, min(root) AS root FROM reach GROUP BY zone, idx) GROUP BY zone""", third=GROUP)
def gr_is_connected(s, d):
    inside = get(s, d, "points").where("idx % 3 = 0")
    links = get(s, d, "edges").where("src % 3 = 0 AND dst % 3 = 0")
    return graph.components(links, inside).groupBy("zone").agg((F.countDistinct("component") == 1).alias("connected"))


def _requests(s, d, shape, size=6):
    return get(s, d, "points").groupBy("zone").agg(F.min("idx").alias("seed_idx")).select("zone", F.lit(1).cast("long").alias("event"), "seed_idx", F.lit(size).alias("size"), F.lit(shape).alias("shape"))


GROW = """
WITH RECURSIVE reach(zone, event, idx, layer) AS (SELECT zone, event, seed_idx, 0 FROM wanted UNION SELECT r.zone, r.event, e.dst, r.layer + 1 FROM reach r JOIN edges e ON e.zone = r.zone AND e.src = r.idx WHERE r.layer < {size})
SELECT zone, event, idx FROM (SELECT zone, event, idx, row_number() OVER (PARTITION BY zone, event ORDER BY layer, md5('{seed}|' || zone || '|' || event || '|' || idx), idx) AS place
  FROM (SELECT zone, event, idx, min(layer) AS layer FROM reach GROUP BY zone, event, idx)) WHERE place <= {size}"""


@query(GROW.format(size=6, seed=5), wanted="SELECT zone, 1 AS event, min(idx) AS seed_idx FROM points GROUP BY zone")
def gr_grow_compact(s, d):
    return inject.subgraphs(get(s, d, "edges"), _requests(s, d, "compact"), seed=5)


@query()
def gr_grow_walk(s, d):
    return inject.subgraphs(get(s, d, "edges"), _requests(s, d, "extended", 4), seed=5)


@query("SELECT zone, idx FROM ball1 WHERE centre = 0 UNION SELECT zone, idx FROM ball1 WHERE centre = 1")
def gr_subgraph(s, d):
    """Compact groups as large as the first two nodes' neighbourhoods: a whole layer is no matter of chance."""
    reach = graph.k_hop(get(s, d, "edges"), get(s, d, "points"), 1).where("centre <= 1")
    size = reach.groupBy("zone", F.col("centre").alias("event")).agg(F.count(F.lit(1)).cast("int").alias("size"))
    wanted = size.select("zone", "event", F.col("event").alias("seed_idx"), "size", F.lit("compact").alias("shape"))
    return inject.subgraphs(get(s, d, "edges"), wanted, seed=9).select("zone", "idx").distinct()


SWEEP = """
WITH RECURSIVE reach(zone, p, idx, root) AS (SELECT zone, p, idx, idx FROM points, (VALUES {ps}) AS g(p) UNION SELECT r.zone, r.p, e.dst, r.root FROM reach r JOIN {lines} e ON e.zone = r.zone AND e.p = r.p AND e.src = r.idx)
SELECT zone, p, coalesce(edges, 0) AS edges, components, isolated, components = 1 AS connected FROM (SELECT zone, p, count(DISTINCT root) AS components, count(*) FILTER (WHERE alone) AS isolated FROM (
  SELECT r.zone, r.p, r.idx, min(root) AS root, count(DISTINCT root) = 1 AS alone FROM reach r GROUP BY r.zone, r.p, r.idx) GROUP BY zone, p)
LEFT JOIN (SELECT zone, p, count(*) // 2 AS edges FROM {lines} GROUP BY zone, p) USING (zone, p)"""
K_LINES = "SELECT DISTINCT zone, k AS p, src, dst FROM (SELECT zone, k, src, dst FROM ranked, (VALUES (2), (3), (5)) AS g(k) WHERE r <= k UNION ALL SELECT zone, k, dst, src FROM ranked, (VALUES (2), (3), (5)) AS g(k) WHERE r <= k)"
R_LINES = "SELECT zone, r AS p, src, dst FROM pairs, (VALUES (5), (1200), (2400), (4800)) AS g(r) WHERE dist <= r"


def _sweep(s, d, lines, values):
    """(zone, p, edges, components, isolated, connected) of the graphs (zone, p, src, dst), zones without edges included; connected by the Fiedler value."""
    name = F.concat_ws("#", "zone", "p").alias("zone")
    graphs = lines.select(name, "src", "dst", F.lit(0.0).alias("dist"), F.lit(1.0).alias("weight"))
    points = get(s, d, "points").withColumn("p", F.explode(F.array(*map(F.lit, values)))).select(name, "idx")
    parts = graph.components(graphs, points).groupBy("zone").agg(F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("n"))
    alone = graph.isolated(points, graphs).groupBy("zone").agg(F.count(F.lit(1)).alias("isolated"))
    edges = graphs.groupBy("zone").agg((F.count(F.lit(1)) / 2).cast("long").alias("edges"))
    fiedler = spectral.spectrum_report(graphs).select("zone", "zeros", "fiedler")
    rows = parts.join(edges, "zone", "left").join(fiedler, "zone", "left").join(alone, "zone", "left").fillna(0, ["isolated", "edges", "zeros"]).fillna(0.0, ["fiedler"])
    key = F.split("zone", "#")
    # a node without edges after the last one with some is beyond the spectrum's matrix, so it is counted here
    one = (F.col("zeros") == 1) & (F.col("fiedler") > 0) & (F.col("isolated") == 0)
    return rows.select(key[0].alias("zone"), key[1].cast("int").alias("p"), "edges", "components", "isolated", one.alias("connected"))


@query(SWEEP.format(lines="k_lines", ps="(2), (3), (5)"), k_lines=K_LINES, ranked="SELECT *, row_number() OVER (PARTITION BY zone, src ORDER BY round(dist, 9), dst) AS r FROM pairs")
def gr_k_sweep(s, d):
    order = Window.partitionBy("zone", "src").orderBy(graph.steps("dist"), "dst")
    ranked = get(s, d, "pairs").withColumn("r", F.row_number().over(order)).where("r <= 5").withColumn("p", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5)))).where("r <= p")
    both = ranked.select("zone", "p", "src", "dst").union(ranked.select("zone", "p", "dst", "src")).distinct()
    return _sweep(s, d, both, (2, 3, 5))


@query(SWEEP.format(lines="r_lines", ps="(5), (1200), (2400), (4800)"), r_lines=R_LINES)
def gr_r_sweep(s, d):
    values = (5, 1200, 2400, 4800)
    rows = graph.near_pairs(get(s, d, "points"), 4800.0).withColumn("p", F.explode(F.array(*map(F.lit, values))))
    return _sweep(s, d, rows.where(F.col("dist") <= F.col("p")).select("zone", "p", "src", "dst"), values)


GLOBAL = """
SELECT za, zb FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(dist, 6), b) AS r FROM (
  SELECT a.device_id AS a, b.device_id AS b, a.zone AS za, b.zone AS zb, sqrt(pow((a.lat - b.lat) * 110574e0, 2e0) + pow((a.lon - b.lon) * 110899e0, 2e0)) AS dist FROM meters a JOIN meters b ON a.device_id <> b.device_id)) WHERE r <= 4"""


@query("SELECT least(za, zb) AS za, greatest(za, zb) AS zb, count(*) AS n FROM everyone WHERE za <> zb GROUP BY ALL", everyone=GLOBAL)
def gr_global_knn(s, d):
    """Neighbours across zones, by the grid of one frame."""
    flat = get(s, d, "meters").select(F.lit("all").alias("zone"), F.col("device_id").alias("idx"), F.col("zone").alias("home"), (F.col("lon") * 110899).alias("x"), (F.col("lat") * 110574).alias("y"))
    near, _ = graph.nearest_in_rings(flat, 4, digits=6)
    both = near.join(flat.select(F.col("idx").alias("src"), F.col("home").alias("za")), "src").join(flat.select(F.col("idx").alias("dst"), F.col("home").alias("zb")), "dst").where("za <> zb")
    return both.groupBy(F.least("za", "zb").alias("za"), F.greatest("za", "zb").alias("zb")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT src AS idx, count(*) AS degree FROM (SELECT a AS src FROM toy UNION ALL SELECT b FROM toy) GROUP BY src", toy="SELECT * FROM (VALUES (0, 1), (1, 2), (3, 4), (5, 6), (7, 8), (0, 3), (3, 5), (5, 7), (7, 9), (9, 0)) AS t(a, b)")
def gr_toy(s, d):
    e = s.createDataFrame([(0, 1), (1, 2), (3, 4), (5, 6), (7, 8), (0, 3), (3, 5), (5, 7), (7, 9), (9, 0)], "src int, dst int")
    both = e.union(e.select("dst", "src"))
    return both.groupBy(F.col("src").alias("idx")).agg(F.count(F.lit(1)).alias("degree"))


TURN = "SELECT zone, idx, row_number() OVER (PARTITION BY zone ORDER BY md5('11|' || zone || '|' || idx), idx) - 1 AS turned FROM points"


def _turned(s, d):
    """(zone, idx, turned): a permutation of each zone's nodes, in the order of a draw."""
    order = Window.partitionBy("zone").orderBy(inject.drawn(11, "zone", "idx"), "idx")
    return get(s, d, "points").select("zone", "idx", (F.row_number().over(order) - 1).cast("long").alias("turned"))


def _renamed(rows, turn, *columns):
    """``rows`` with the nodes in ``columns`` renamed."""
    for c in columns:
        rows = rows.withColumnRenamed(c, "__old").join(turn.select("zone", F.col("idx").alias("__old"), F.col("turned").alias(c)), ["zone", "__old"]).drop("__old")
    return rows


@query("SELECT e.zone, a.turned AS src, b.turned AS dst, round(dist, 6) AS dist FROM edges e JOIN turn a ON a.zone = e.zone AND a.idx = e.src JOIN turn b ON b.zone = e.zone AND b.idx = e.dst", turn=TURN)
def gr_permute(s, d):
    return r6(_renamed(get(s, d, "edges"), _turned(s, d), "src", "dst").select("zone", "src", "dst", "dist"), "dist")


# --- spectra and filters ---

WHOLE = "SELECT zone, t, idx, value FROM (SELECT *, count(*) OVER (PARTITION BY zone, t) AS k FROM signal) JOIN (SELECT zone, count(*) AS n FROM points GROUP BY zone) USING (zone) WHERE k = n"


@query("SELECT zone, src AS i, dst AS j, -weight AS value FROM edges UNION ALL SELECT zone, idx, idx, degree FROM degrees")
def sp_laplacian(s, d):
    return spectral.laplacian(get(s, d, "points"), get(s, d, "edges"))


@query("SELECT e.zone, src AS i, dst AS j, round(-weight / sqrt(a.degree * b.degree), 9) AS value FROM edges e JOIN degrees a ON a.zone = e.zone AND a.idx = src JOIN degrees b ON b.zone = e.zone AND b.idx = dst UNION ALL SELECT zone, idx, idx, 1e0 FROM degrees")
def sp_laplacian_norm(s, d):
    return spectral.laplacian_norm(get(s, d, "edges")).withColumn("value", F.round("value", 9))


NORMAL = "SELECT e.zone, src AS i, dst AS j, -weight / sqrt(a.degree * b.degree) AS v FROM edges e JOIN degrees a ON a.zone = e.zone AND a.idx = src JOIN degrees b ON b.zone = e.zone AND b.idx = dst UNION ALL SELECT zone, idx, idx, 1e0 FROM degrees"


@query("""
SELECT zone, n, trace, squares, cubes FROM (SELECT zone, count(*) AS n, count(*)::DOUBLE AS trace FROM degrees GROUP BY zone)
JOIN (SELECT zone, round(sum(v * v), 6) AS squares FROM normal GROUP BY zone) USING (zone)
JOIN (SELECT a.zone, round(sum(a.v * b.v * c.v), 6) AS cubes FROM normal a JOIN normal b ON b.zone = a.zone AND b.i = a.j JOIN normal c ON c.zone = a.zone AND c.i = b.j AND c.j = a.i GROUP BY a.zone) USING (zone)""", normal=NORMAL)
def sp_eigh(s, d):
    """Sums of powers of the eigenvalues, which are traces of powers of the matrix."""
    rows = spectral.spectrum(get(s, d, "edges"))
    x = F.col("eigenvalue")
    return rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(x), 6).alias("trace"), F.round(F.sum(x * x), 6).alias("squares"), F.round(F.sum(x * x * x), 6).alias("cubes"))


@query("SELECT zone, t, idx, round(value, 6) AS value FROM whole", whole=WHOLE)
def sp_igft(s, d):
    e, x = get(s, d, "edges"), _whole(s, d)
    return r6(spectral.gft(e, spectral.gft(e, x), inverse=True), "value")


@query("""
WITH RECURSIVE reach(zone, idx, root) AS (SELECT zone, idx, idx FROM points UNION SELECT r.zone, e.dst, r.root FROM reach r JOIN edges e ON e.zone = r.zone AND e.src = r.idx)
SELECT zone, count(DISTINCT root) AS zeros FROM (SELECT zone, idx, min(root) AS root FROM reach GROUP BY zone, idx) GROUP BY zone""")
def sp_zero_mult(s, d):
    """Zero is an eigenvalue once a component, so components tell it in zones of any size."""
    return graph.components(get(s, d, "edges"), get(s, d, "points")).groupBy("zone").agg(F.count_distinct("component").alias("zeros"))


@query()
def sp_fiedler(s, d):
    return r6(spectral.spectrum_report(get(s, d, "edges")), "fiedler").select("zone", "fiedler")


@query()
def sp_degenerate(s, d):
    return spectral.spectrum_report(get(s, d, "edges")).select("zone", "max_multiplicity")


@query()
def sp_band_cut(s, d):
    return r6(spectral.spectrum_report(get(s, d, "edges")), "cut_value").select("zone", "cut", "cut_value")


@query()
def sp_cut_report(s, d):
    return spectral.spectrum_report(get(s, d, "edges"))


@query()
def sp_spectrum_report(s, d):
    return r6(spectral.spectrum_report(get(s, d, "edges")), "largest", "fiedler", "cut_value")


TOY = """
SELECT 'cycle' AS zone, 1 - cos(2e0 * pi() * i / 12) AS v FROM range(12) AS t(i) UNION ALL SELECT 'path', 1 - cos(pi() * i / 8) FROM range(9) AS t(i)
UNION ALL SELECT 'complete', CASE WHEN i = 0 THEN 0e0 ELSE 6e0 / 5 END FROM range(6) AS t(i) UNION ALL SELECT 'star', CASE WHEN i = 0 THEN 0e0 WHEN i = 7 THEN 2e0 ELSE 1e0 END FROM range(8) AS t(i)"""
TOY_RANKED = "SELECT zone, v, row_number() OVER (PARTITION BY zone ORDER BY v) - 1 AS k FROM toy_values"


def _toys(s):
    """A cycle, a path, a complete graph and a star, whose spectra are known."""
    pairs = [("cycle", i, (i + 1) % 12) for i in range(12)] + [("path", i, i + 1) for i in range(8)]
    pairs += [("complete", i, j) for i in range(6) for j in range(i)] + [("star", 0, i) for i in range(1, 8)]
    return s.createDataFrame([(z, *e, 1.0) for z, a, b in pairs for e in ((a, b), (b, a))], "zone string, src long, dst long, weight double")


@query("SELECT zone, k, round(v, 9) + 0e0 AS eigenvalue FROM toy_ranked", toy_values=TOY, toy_ranked=TOY_RANKED)
def sp_known_spectra(s, d):
    return spectral.spectrum(_toys(s)).select("zone", "k", (F.round(F.abs("eigenvalue"), 9) + 0.0).alias("eigenvalue"))


@query("""
SELECT zone, round(max(v), 9) AS largest, count(*) FILTER (WHERE v < 1e-9) AS zeros, round(min(v) FILTER (WHERE v > 1e-9), 9) AS fiedler, max(same) AS max_multiplicity
FROM (SELECT *, count(*) OVER (PARTITION BY zone, round(v, 9)) AS same FROM toy_values) GROUP BY zone""", toy_values=TOY)
def sp_known_reports(s, d):
    return r9(spectral.spectrum_report(_toys(s)), "largest", "fiedler").select("zone", "largest", "zeros", "fiedler", "max_multiplicity")


@query("SELECT 'cycle' AS zone, t, idx, round(cos(2 * pi() * t * idx / 12) * exp(-(1 - cos(2 * pi() * t / 12)) / (0.5 * 2)), 9) + 0e0 AS value FROM range(6) AS a(t), range(12) AS b(idx)")
def sp_known_diffusion(s, d):
    """Waves around a cycle are its eigenvectors: diffusion scales each by its gain."""
    cycle = _toys(s).where("zone = 'cycle'")
    wave = s.range(6).select(F.lit("cycle").alias("zone"), F.col("id").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("idx"))
    wave = wave.withColumn("value", F.cos(2 * F.lit(math.pi) * F.col("t") * F.col("idx") / 12))
    return spectral.diffuse(cycle, wave, 0.5).withColumn("value", F.round("value", 9) + 0.0)


@query("SELECT 'cycle' AS zone, tau, round(exp(-2 * (1 - cos(2 * pi() * 2 / 12)) / (tau * 2)), 9) AS retained FROM (VALUES (0.1e0), (0.5e0), (2e0)) AS v(tau)")
def sp_known_tau(s, d):
    cycle = _toys(s).where("zone = 'cycle'")
    wave = s.range(12).select(F.lit("cycle").alias("zone"), F.lit(0).cast("long").alias("t"), F.col("id").alias("idx"), F.cos(2 * F.lit(math.pi) * 2 * F.col("id") / 12).alias("value"))
    return r9(spectral.tau_sweep(cycle, wave, (0.1, 0.5, 2.0)).select("zone", "tau", "retained"), "retained")


@query("SELECT zone, k, round(exp(-v / (0.5 * top)), 9) AS falling, round(exp(v / (0.5 * top)), 9) AS rising FROM toy_ranked JOIN (SELECT zone, max(v) AS top FROM toy_values GROUP BY zone) USING (zone)", toy_values=TOY, toy_ranked=TOY_RANKED)
def sp_known_gains(s, d):
    return r9(_gains(spectral.spectrum(_toys(s))), "falling", "rising")


def _gains(rows):
    """(zone, k, falling, rising): both filters' gains by the operator itself, a zone's eigenvalues at once."""

    def zone(pdf):
        values = pdf.sort_values("k")["eigenvalue"].to_numpy()
        return pd.DataFrame({"zone": pdf["zone"].iloc[0], "k": range(len(values)), "falling": spectral.low_pass(values, 0.5), "rising": spectral.low_pass(values, 0.5, sign=1)})

    return rows.select("zone", "k", "eigenvalue").groupBy("zone").applyInPandas(zone, "zone string, k long, falling double, rising double")


@query()
def sp_low_pass(s, d):
    return _gains(spectral.spectrum(get(s, d, "edges"))).select("zone", "k", F.col("falling").alias("gain"))


@query()
def sp_published(s, d):
    return _gains(spectral.spectrum(get(s, d, "edges"))).select("zone", "k", F.col("rising").alias("gain"))


@query()
def sp_diffuse(s, d):
    return r6(spectral.diffuse(get(s, d, "edges"), _whole(s, d), 0.5), "value")


DIRICHLET = "SELECT e.zone, a.t, {r}sum(weight * pow(a.value{na} - b.value{nb}, 2e0)){e} AS energy FROM edges e JOIN {x} a ON a.zone = e.zone AND a.idx = src JOIN {x} b ON b.zone = e.zone AND b.idx = dst AND b.t = a.t {j} WHERE src < dst GROUP BY e.zone, a.t"
JOINED = "JOIN degrees da ON da.zone = e.zone AND da.idx = src JOIN degrees db ON db.zone = e.zone AND db.idx = dst"


def _dirichlet_sql(x="signal", norm=True):
    return DIRICHLET.format(r="round(", e=", 4)", x=x, na=" / sqrt(da.degree)" if norm else "", nb=" / sqrt(db.degree)" if norm else "", j=JOINED if norm else "")


CENTRED = "SELECT zone, t, idx, value - avg(value) OVER (PARTITION BY zone, t) AS value FROM signal"


@query(_dirichlet_sql())
def sp_dirichlet(s, d):
    return spectral.dirichlet(get(s, d, "signal"), get(s, d, "edges")).withColumn("energy", F.round("energy", 4))


@query(_dirichlet_sql(norm=False))
def sp_dirichlet_comb(s, d):
    return spectral.dirichlet(get(s, d, "signal"), get(s, d, "edges"), normalised=False).withColumn("energy", F.round("energy", 4))


@query(_dirichlet_sql("centred_signal"), centred_signal=CENTRED)
def sp_dirichlet_centered(s, d):
    return spectral.dirichlet(spectral.centred(get(s, d, "signal")), get(s, d, "edges")).withColumn("energy", F.round("energy", 4))


RESIDUAL = "SELECT x.zone, x.t, x.idx, x.value - m AS residual FROM signal x JOIN (SELECT e.zone, y.t, e.src AS idx, sum(weight * y.value) / sum(weight) AS m FROM edges e JOIN signal y ON y.zone = e.zone AND y.idx = e.dst GROUP BY ALL) USING (zone, t, idx)"


@query(f"SELECT zone, t, round(max(abs(residual)) / {SIGMA}e0, 6) AS statistic FROM residuals GROUP BY zone, t", residuals=RESIDUAL)
def sp_local_residual(s, d):
    rows = spectral.local_residual(get(s, d, "signal"), get(s, d, "edges"))
    return rows.groupBy("zone", "t").agg(F.round(F.max(F.abs("residual")) / SIGMA, 6).alias("statistic"))


@query("SELECT zone, t, round(sum(weight * pow(va / sqrt(da) - vb / sqrt(db), 2e0)) / max(norm), 6) AS quotient FROM (SELECT e.zone, a.t, weight, a.value AS va, b.value AS vb, da.degree AS da, db.degree AS db FROM edges e JOIN signal a ON a.zone = e.zone AND a.idx = src JOIN signal b ON b.zone = e.zone AND b.idx = dst AND b.t = a.t " + JOINED + " WHERE src < dst) JOIN (SELECT zone, t, sum(value * value) AS norm FROM signal GROUP BY zone, t) USING (zone, t) GROUP BY zone, t")
def sp_rayleigh(s, d):
    x = get(s, d, "signal")
    norm = x.groupBy("zone", "t").agg(F.sum(F.col("value") * F.col("value")).alias("norm"))
    return spectral.dirichlet(x, get(s, d, "edges")).join(norm, ["zone", "t"]).select("zone", "t", F.round(F.col("energy") / F.col("norm"), 6).alias("quotient"))


@query("SELECT zone, t, idx, round(value - sqrt(degree) * sum(value * sqrt(degree)) OVER w / sum(degree) OVER w, 6) AS value FROM signal JOIN degrees USING (zone, idx) WINDOW w AS (PARTITION BY zone, t)")
def sp_project_kernel(s, d):
    return r6(spectral.project_kernel(get(s, d, "signal"), get(s, d, "edges")), "value")


@query()
def sp_band_energy(s, d):
    return r6(spectral.band_energy(get(s, d, "edges"), _whole(s, d)), "low", "high", "total", "high_fraction").select("zone", "t", "low", "high", "total", "high_fraction")


@query()
def sp_profile(s, d):
    return spectral.band_energy(get(s, d, "edges"), _whole(s, d)).select("zone", "t", "mode_zero", "high_without_mean", "rayleigh")


@query()
def sp_score_topk(s, d):
    return spectral.top_mode_score(get(s, d, "edges"), _whole(s, d))


@query("SELECT zone, t, idx, round(pow(value - coalesce(m, 0e0), 2e0), 4) AS score FROM signal LEFT JOIN (SELECT e.zone, y.t, e.src AS idx, sum(weight * y.value / sqrt(a.degree * b.degree)) AS m FROM edges e JOIN signal y ON y.zone = e.zone AND y.idx = e.dst JOIN degrees a ON a.zone = e.zone AND a.idx = src JOIN degrees b ON b.zone = e.zone AND b.idx = dst GROUP BY ALL) USING (zone, t, idx)")
def sp_score_smooth(s, d):
    lap = spectral.laplacian_norm(get(s, d, "edges"))
    rows = lap.join(get(s, d, "signal").withColumnRenamed("value", "x").withColumnRenamed("idx", "j"), ["zone", "j"])
    y = rows.groupBy("zone", "t", F.col("i").alias("idx")).agg(F.sum(F.col("value") * F.col("x")).alias("y"))
    return y.select("zone", "t", "idx", F.round(F.col("y") * F.col("y"), 4).alias("score"))


@query()
def sp_spike_signal(s, d):
    base = inject.null_signal(get(s, d, "points"), 1, 10.0, 0.3, seed=11)
    top = F.row_number().over(Window.partitionBy("zone").orderBy(F.xxhash64("zone", "idx"))) == 1
    return base.withColumn("value", F.col("value") + F.when(top, 5.0).otherwise(0.0))


@query("SELECT DISTINCT zone, TRUE AS same FROM whole", whole=WHOLE)
def sp_permutation_check(s, d):
    """Diffusion commutes with a renaming of nodes."""
    e, x, turn = get(s, d, "edges"), _whole(s, d), _turned(s, d)
    a = _renamed(spectral.diffuse(e, x), turn, "idx").withColumnRenamed("value", "u")
    both = a.join(spectral.diffuse(_renamed(e, turn, "src", "dst"), _renamed(x, turn, "idx")), ["zone", "t", "idx"])
    return both.groupBy("zone").agg((F.max(F.abs(F.col("u") - F.col("value"))) < 1e-6).alias("same"))


@query("SELECT zone, t, count(*) AS n, count(*) FILTER (WHERE isnan(value) OR isinf(value)) AS broken FROM signal GROUP BY zone, t")
def sp_validate(s, d):
    return get(s, d, "signal").groupBy("zone", "t").agg(F.count(F.lit(1)).alias("n"), F.count_if(~registry.finite(F.col("value"))).alias("broken"))


# --- stream rules, batch form ---

VERDICTS = f"""
SELECT id, CASE WHEN zone IS NULL THEN 'unknown' WHEN ahead THEN 'future' WHEN bin <= newest THEN 'late'
  WHEN row_number() OVER (PARTITION BY device_id, bin, (zone IS NULL OR ahead OR coalesce(bin <= newest, FALSE)) ORDER BY ts_us DESC, arrival_us, id) > 1 THEN 'superseded' ELSE 'accepted' END AS verdict
FROM (SELECT t.id, m.zone, t.device_id, t.ts_us, t.arrival_us, t.ts_us - t.arrival_us > 500000 AS ahead, t.ts_us // {GAPPY} AS bin, (SELECT max(e.bin) FROM emitted e WHERE e.zone = m.zone AND e.at_us <= t.arrival_us) AS newest
  FROM telemetry t LEFT JOIN (SELECT device_id, zone FROM meters WHERE active IS NOT FALSE) m USING (device_id))"""
EMITTED = f"SELECT zone, (bin + 1) * {GAPPY} - {DAY_US} AS at_us, bin FROM (SELECT DISTINCT zone, bin FROM cells)"


def _verdicts(s, d):
    config = windows.WindowConfig(bin_us=GAPPY, length=LENGTH, max_future_us=500_000)
    emitted = get(s, d, "cells").select("zone", ((F.col("bin") + 1) * GAPPY - DAY_US).alias("at_us"), "bin").distinct()
    known = get(s, d, "meters").where("coalesce(active, TRUE)")
    return windows.classify(get(s, d, "telemetry"), known, emitted, config)


@query("SELECT id, verdict FROM verdicts", verdicts=VERDICTS, emitted=EMITTED)
def st_observe(s, d):
    return _verdicts(s, d).select("id", "verdict")


@query("SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict", verdicts=VERDICTS, emitted=EMITTED)
def st_observe_many(s, d):
    return _verdicts(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


for _kind in ("unknown", "late", "future", "superseded"):

    def _one(s, d, kind=_kind):
        return _verdicts(s, d).where(F.col("verdict") == kind).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))

    _one.__name__ = f"st_{_kind}"
    query(f"SELECT t.zone, count(*) AS n FROM verdicts v JOIN telemetry t USING (id) WHERE verdict = '{_kind}' GROUP BY t.zone", verdicts=VERDICTS, emitted=EMITTED)(_one)


@query(f"SELECT arrival_us // {GAPPY} AS cycle, verdict, count(*) AS n FROM verdicts JOIN telemetry USING (id) GROUP BY ALL", verdicts=VERDICTS, emitted=EMITTED)
def st_counters_delta(s, d):
    return _verdicts(s, d).groupBy(windows.bin_of(F.col("arrival_us"), GAPPY).alias("cycle"), "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM verdicts WHERE verdict = 'late'", verdicts=VERDICTS, emitted=EMITTED)
def st_late_rule(s, d):
    return _verdicts(s, d).where("verdict = 'late'").select("id")


def _replayed(s, d, where="TRUE"):
    from ..streaming import processor

    config = windows.WindowConfig(bin_us=GAPPY, length=LENGTH, grace_us=0)
    ticks = get(s, d, "cells").where(where).select("zone", ((F.col("bin") + 1) * GAPPY + 10_000_000).alias("at_us")).distinct()
    return processor.replay(get(s, d, "telemetry"), get(s, d, "meters"), ticks, config)


@query("SELECT zone, bin, coalesce(bin - lag(bin) OVER (PARTITION BY zone ORDER BY bin) - 1, 0)::INTEGER AS skipped FROM (SELECT DISTINCT zone, bin FROM cells WHERE bin % 3 <> 1)")
def st_emit(s, d):
    """Emission at some ticks only: each bin at most once, and those without a tick are counted as skipped."""
    return _replayed(s, d, "bin % 3 <> 1").select("zone", "bin", "skipped")



# --- detector ---


@query("SELECT zone, radius, centre, size, n FROM balls")
def dt_balls(s, d):
    return get(s, d, "balls").drop("members")


@query("SELECT zone, bin, radius, centre, round(statistic, 6) AS statistic FROM scores")
def dt_contrast(s, d):
    return r6(get(s, d, "scores"), "statistic").drop("size")


@query(f"SELECT {SIGMA}e0 / sqrt({LENGTH}e0) AS sigma_eff")
def dt_sigma_eff(s, d):
    return s.range(1).select((F.lit(SIGMA) / F.sqrt(F.lit(float(LENGTH)))).alias("sigma_eff"))


def _plans(s, d):
    """Each zone's balls with one threshold for all."""
    zones = get(s, d, "balls").select("zone").distinct()
    return detect.plans(get(s, d, "balls"), zones.select("zone", F.lit(THRESHOLD).alias("threshold"), F.lit(SIGMA).alias("sigma"), F.lit(LENGTH).alias("window")))


def _detections(s, d):
    return detect.scan(detect.mean_arrays(get(s, d, "means")), _plans(s, d)).drop("means", "threshold")


@query("SELECT zone, bin, detected, round(statistic, 6) AS statistic, candidates, radius, centre, size FROM winners", winners=WINNERS, places=PLACES)
def dt_detect(s, d):
    return r6(_detections(s, d), "statistic")


@query("SELECT zone, bin, round(statistic, 6) AS statistic, detected FROM winners", winners=WINNERS, places=PLACES)
def dt_score(s, d):
    return r6(_detections(s, d), "statistic").select("zone", "bin", "statistic", "detected")


@query(f"SELECT DISTINCT w.zone, unnest(generate_series(w.bin - {LENGTH - 1}, w.bin)) AS t, b.idx FROM winners w JOIN ball_members b USING (zone, radius, centre) WHERE detected", winners=WINNERS, places=PLACES)
def dt_node_mask(s, d):
    return detect.node_mask(_detections(s, d), get(s, d, "balls"), LENGTH)


@query()
def dt_calibrate(s, d):
    return detect.calibrate(get(s, d, "balls"), 1.0, detect.DetectorConfig(), seed=7)


@query()
def dt_calibrate_all(s, d):
    """Each zone's threshold from 2000 signals of 64 instants, and its false alarms on a long signal without events."""
    config = detect.DetectorConfig(step=1)
    cuts = detect.calibrate(get(s, d, "balls"), 1.0, config, seed=7, instants=64)
    return cuts.join(detect.validate(get(s, d, "balls"), cuts, 1.0, config), "zone")


def _live(s, d, skip=None):
    """What a running monitor has: spread, window and fingerprint of each zone, and without the first node's edges in the zone ``skip``."""
    links = get(s, d, "edges")
    if skip:
        links = links.where(~((F.col("zone") == skip) & ((F.col("src") == 0) | (F.col("dst") == 0))))
    return inject.fingerprints(get(s, d, "points"), links).withColumns({"sigma": F.lit(1.0), "window": F.lit(16)})


def _frozen(s, d):
    """Calibrated thresholds, of which one zone's window and another's wiring are of an older network."""
    old = _live(s, d, skip="z000001").withColumn("window", F.when(F.col("zone") == "z000002", 8).otherwise(F.col("window")))
    cuts = detect.calibrate(get(s, d, "balls"), 1.0, detect.DetectorConfig(), seed=7).select("zone", "threshold")
    return old.join(cuts, "zone")


@query("SELECT zone, CASE zone WHEN 'z000001' THEN 'changed' ELSE 'window' END AS problem FROM meters WHERE zone IN ('z000001', 'z000002') GROUP BY zone")
def dt_freeze(s, d):
    return detect.check_frozen(_frozen(s, d), _live(s, d))


@query("SELECT zone, TRUE AS positive FROM meters WHERE zone NOT IN ('z000001', 'z000002') GROUP BY zone")
def dt_load(s, d):
    frozen = _frozen(s, d)
    return frozen.join(detect.check_frozen(frozen, _live(s, d)), "zone", "left_anti").select("zone", (F.col("threshold") > 0).alias("positive"))


@query(f"SELECT zone, bin, round(max(abs(mean - 50e0)) / ({SIGMA}e0 / sqrt({LENGTH}e0)), 6) AS statistic FROM means GROUP BY zone, bin")
def dt_meter_threshold(s, d):
    return r6(detect.meter_threshold(get(s, d, "means"), 50.0, SIGMA, LENGTH), "statistic")


@query(f"SELECT zone, bin, round(abs(inside / k - (total - inside) / (n - k)) / ({SIGMA}e0 / sqrt({LENGTH}e0) * sqrt(1e0 / k + 1e0 / (n - k))), 6) AS statistic FROM (SELECT zone, bin, sum(mean) FILTER (WHERE idx % 3 = 0) AS inside, sum(mean) AS total, count(*) FILTER (WHERE idx % 3 = 0) AS k, count(*) AS n FROM means GROUP BY zone, bin)")
def dt_oracle(s, d):
    p = get(s, d, "points")
    group = p.groupBy("zone").agg(F.lit(0).alias("radius"), F.lit(0).alias("centre"), F.count_if(F.col("idx") % 3 == 0).alias("size"), F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("idx") % 3 == 0, F.col("idx"))).alias("members"))
    return r6(detect.contrasts(get(s, d, "means"), group, SIGMA, LENGTH), "statistic").select("zone", "bin", "statistic")


@query(f"SELECT zone, bin, round(max(abs(inside / size - (total - inside) / (n - size)) / ({SIGMA}e0 / sqrt({LENGTH}e0) * sqrt(1e0 / size + 1e0 / (n - size)))), 6) AS statistic FROM (SELECT b.zone, m.bin, b.centre, count(*) AS size, sum(m.mean) AS inside FROM means m JOIN ball1 b USING (zone, idx) GROUP BY ALL) JOIN (SELECT zone, bin, sum(mean) AS total, count(*) AS n FROM means GROUP BY zone, bin) USING (zone, bin) WHERE size < n GROUP BY zone, bin")
def dt_scan_r1(s, d):
    p = get(s, d, "points")
    n = p.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    every = graph.k_hop(get(s, d, "edges"), p, 1).groupBy("zone", "centre").agg(F.collect_list("idx").alias("members"), F.count(F.lit(1)).alias("size")).withColumn("radius", F.lit(1)).join(n, "zone").where("size < n")
    return r6(detect.contrasts(get(s, d, "means"), every, SIGMA, LENGTH).groupBy("zone", "bin").agg(F.max("statistic").alias("statistic")), "statistic")


# --- events and evaluation ---

EVENTS = "SELECT zone, 1 AS event, min(t) + 1 AS start, 2 AS duration, 1.5e0 AS sigma_multiple, 1 AS direction FROM signal GROUP BY zone"
GROUPS = "SELECT zone, 1 AS event, idx FROM ball1 WHERE centre = 0"
DELTAS = "SELECT g.zone, g.event, unnest(generate_series(e.start, e.start + e.duration - 1)) AS t, g.idx, direction * sigma_multiple * sigma AS delta FROM groups g JOIN event_list e USING (zone, event) JOIN sigma_list USING (zone, idx)"
SIGMAS = "SELECT zone, idx, CASE WHEN device_id LIKE 'dev-tri%' THEN 20e0 ELSE 10e0 END AS sigma FROM points"
EV = {"event_list": EVENTS, "groups": GROUPS, "deltas": DELTAS, "sigma_list": SIGMAS}


def _event(s, d):
    x = get(s, d, "signal")
    events = x.groupBy("zone").agg((F.min("t") + 1).alias("start")).select("zone", F.lit(1).alias("event"), "start", F.lit(2).alias("duration"), F.lit(1.5).alias("sigma_multiple"), F.lit(1).alias("direction"))
    groups = graph.k_hop(get(s, d, "edges"), get(s, d, "points"), 1).where("centre = 0").select("zone", F.lit(1).alias("event"), "idx")
    sigmas = get(s, d, "points").select("zone", "idx", F.when(F.col("device_id").startswith("dev-tri"), 20.0).otherwise(10.0).alias("sigma"))
    return x, events, groups, sigmas


def _deltas(s, d):
    x, events, groups, sigmas = _event(s, d)
    return x, inject.deltas(groups, events, sigmas)


@query("""
SELECT zone, event, arg_min(idx, md5('3|' || zone || '|' || event || '|' || device_id)) AS seed FROM points, (VALUES (1), (2), (3)) AS e(event) GROUP BY zone, event""")
def ev_seed(s, d):
    """Three events a zone, each at a meter drawn for it."""
    wanted = get(s, d, "meters").select("zone").distinct().select("zone", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("event"))
    return inject.seeds(get(s, d, "points"), wanted, seed=3).select("zone", "event", F.col("seed_idx").alias("seed"))


@query("SELECT zone, idx FROM groups", **EV)
def ev_group(s, d):
    return _event(s, d)[2].select("zone", "idx")


@query("SELECT zone, t, idx, delta FROM deltas", **EV)
def ev_delta(s, d):
    return _deltas(s, d)[1].select("zone", "t", "idx", "delta")


@query("SELECT unnest(generate_series(0, 4)) AS step, 1e0 AS weight")
def ev_step_profile(s, d):
    return s.range(5).select(F.col("id").alias("step"), F.lit(1.0).alias("weight"))


#: Two events that share meters and an instant: the first by spread around meter 0, the second by fraction around meter 1.
PAIR = EV | {
    "first_cells": "SELECT zone, t, idx, delta FROM deltas",
    "second_cells": "SELECT zone, unnest(generate_series(start + 1, start + 2)) AS t, idx FROM event_list JOIN (SELECT zone, idx FROM ball1 WHERE centre = 1) USING (zone)",
    "bounded_first": "SELECT zone, least(1e0, min(greatest(0e0, 120e0 - value) / delta)) AS scale FROM first_cells JOIN signal USING (zone, t, idx) GROUP BY zone",
    "after_first": "SELECT s.zone, s.t, s.idx, value, delta IS NOT NULL AS hit1, coalesce(delta * b.scale, 0e0) AS d1, value + coalesce(delta * b.scale, 0e0) AS v1 FROM signal s LEFT JOIN first_cells USING (zone, t, idx) LEFT JOIN bounded_first b ON b.zone = s.zone",
    "bounded_second": "SELECT zone, least(1e0, coalesce(min(greatest(0e0, 120e0 - v1) / (0.5e0 * v1)) FILTER (WHERE v1 > 0), 1e0)) AS scale FROM second_cells JOIN after_first USING (zone, t, idx) GROUP BY zone",
    "after_both": "SELECT a.*, c.zone IS NOT NULL AS hit2, CASE WHEN c.zone IS NULL THEN 0e0 ELSE 0.5e0 * v1 * b.scale END AS d2 FROM after_first a LEFT JOIN second_cells c USING (zone, t, idx) LEFT JOIN bounded_second b ON b.zone = a.zone",
}


def _pair(s, d):
    x, events, groups, sigmas = _event(s, d)
    second = events.select("zone", F.lit(2).alias("event"), (F.col("start") + 1).alias("start"), F.lit(2).alias("duration"), F.lit(None).cast("double").alias("sigma_multiple"), "direction", F.lit(0.5).alias("fraction"))
    around = graph.k_hop(get(s, d, "edges"), get(s, d, "points"), 1).where("centre = 1").select("zone", F.lit(2).alias("event"), "idx")
    events, groups = events.withColumn("fraction", F.lit(None).cast("double")).unionByName(second), groups.unionByName(around)
    return x, events, groups, inject.changes(groups, events, sigmas)


@query("SELECT zone, 1 AS event, round(scale, 6) AS scale FROM bounded_first UNION ALL SELECT zone, 2, round(scale, 6) FROM bounded_second", **PAIR)
def ev_scale(s, d):
    """The second event's factor depends on what the first left."""
    x, _, _, asked = _pair(s, d)
    return inject.scale_to_bounds(x, asked, -1e9, 120.0).select("zone", "event", F.round("scale", 6).alias("scale"))


@query("""
SELECT zone, t, idx, round(v1 + CASE WHEN c.zone IS NULL THEN 0e0 ELSE 0.5e0 * v1 END, 6) AS value, value AS base, touched OR c.zone IS NOT NULL AS truth
FROM (SELECT s.zone, s.t, s.idx, value, value + coalesce(delta, 0e0) AS v1, delta IS NOT NULL AS touched FROM signal s LEFT JOIN first_cells USING (zone, t, idx)) LEFT JOIN second_cells c USING (zone, t, idx)""", **PAIR)
def ev_inject(s, d):
    """Spread and fraction mixed, without bounds."""
    x, _, _, asked = _pair(s, d)
    return r6(inject.inject(x, asked), "value")


@query("SELECT zone, t, idx, round(v1 + d2, 6) AS value, value AS base, hit1 OR hit2 AS truth FROM after_both", **PAIR)
def ev_apply(s, d):
    """The same within bounds: each event shrinks by its own factor."""
    x, _, _, asked = _pair(s, d)
    return r6(inject.inject(x, asked, -1e9, 120.0, "scale"), "value")


@query("""
WITH did AS (SELECT zone, 1 AS event, max(abs(d1)) AS most FROM first_cells JOIN after_both USING (zone, t, idx) GROUP BY zone
  UNION ALL SELECT zone, 2, max(abs(d2)) FROM after_both WHERE hit2 GROUP BY zone),
members AS (SELECT zone, centre + 1 AS event, idx FROM ball1 WHERE centre <= 1),
cut AS (SELECT m.zone, m.event, count(*) AS boundary_edges FROM members m JOIN edges e ON e.zone = m.zone AND e.src = m.idx
  WHERE NOT EXISTS (SELECT 1 FROM members o WHERE o.zone = m.zone AND o.event = m.event AND o.idx = e.dst) GROUP BY m.zone, m.event),
scales AS (SELECT zone, 1 AS event, scale FROM bounded_first UNION ALL SELECT zone, 2, scale FROM bounded_second)
SELECT zone, event, n_nodes, coalesce(boundary_edges, 0) AS boundary_edges, zone_size, n_nodes / zone_size AS coverage, coalesce(boundary_edges, 0) / n_nodes AS boundary_per_node,
  round(most, 6) AS max_abs_delta, coalesce(scale < 1, FALSE) AS scaled, round(CASE WHEN event = 1 THEN 1.5e0 * coalesce(scale, 1e0) END, 6) AS sigma_multiple, round(CASE WHEN event = 2 THEN 0.5e0 * coalesce(scale, 1e0) END, 6) AS fraction, n_nodes < zone_size AS expected_detectable
FROM (SELECT zone, event, count(*) AS n_nodes FROM members GROUP BY zone, event) JOIN (SELECT zone, count(*) AS zone_size FROM points GROUP BY zone) USING (zone)
JOIN (SELECT DISTINCT zone FROM event_list) USING (zone) LEFT JOIN did USING (zone, event) LEFT JOIN cut USING (zone, event) LEFT JOIN scales USING (zone, event)""".replace("WITH did", "WITH RECURSIVE did"), **PAIR)
def ev_coverage(s, d):
    """Each event's record of truth: size, boundary, what was applied."""
    x, events, groups, asked = _pair(s, d)
    _, done = inject.apply_events(x, asked, -1e9, 120.0, "scale")
    rows = inject.truth(done, groups, events, get(s, d, "edges"), get(s, d, "points"))
    return r6(rows, "max_abs_delta", "sigma_multiple", "fraction").select(
        "zone", "event", "n_nodes", "boundary_edges", "zone_size", "coverage", "boundary_per_node", "max_abs_delta", "scaled", "sigma_multiple", "fraction", "expected_detectable"
    )


@query("SELECT zone, t, idx, round(CASE WHEN delta IS NULL THEN value ELSE value * 1.1e0 * 1.1e0 END, 6) AS value, value AS base, delta IS NOT NULL AS truth FROM signal LEFT JOIN deltas USING (zone, t, idx)", **EV)
def ev_inject_fraction(s, d):
    """Two events on the same cells: the second sees what the first left."""
    x, events, groups, _ = _event(s, d)
    two = events.select("zone", "event", "start", "duration", F.lit(0.1).alias("fraction"), "direction")
    two = two.union(two.withColumn("event", F.lit(2)))
    return r6(inject.inject_in_order(x, groups.union(groups.withColumn("event", F.lit(2))), two), "value")


@query("SELECT DISTINCT zone, t, idx FROM deltas", **EV)
def ev_truth_mask(s, d):
    return inject.inject(*_deltas(s, d)).where("truth").select("zone", "t", "idx")


@query("SELECT zone, t, idx, round(value, 6) AS value FROM signal")
def ev_reconstruct(s, d):
    x, change = _deltas(s, d)
    rows = inject.inject(x, change).join(change.select("zone", "t", "idx", "delta"), ["zone", "t", "idx"], "left")
    return rows.select("zone", "t", "idx", F.round(F.col("value") - F.coalesce("delta", F.lit(0.0)), 6).alias("value"))


LABELS = "SELECT id, zone, voltage > 215 AS label, value AS score FROM telemetry"


def _labels(s, d):
    return get(s, d, "telemetry").select("id", "zone", (F.col("voltage") > 215).alias("label"), F.col("value").alias("score"))


@query("SELECT zone, p, q, round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM (SELECT zone, sum(CASE WHEN label THEN r END)::DOUBLE AS s, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS q FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY score, id) AS r FROM marks) GROUP BY zone)", marks=LABELS)
def el_auc(s, d):
    return r6(evaluate.auc(_labels(s, d), "zone"), "auc")


@query("SELECT round(avg(CASE WHEN score > cut THEN 1e0 ELSE 0e0 END), 6) AS rate, round(max(cut), 6) AS cut FROM marks, (SELECT percentile_cont(0.99) WITHIN GROUP (ORDER BY score) AS cut FROM marks WHERE NOT label) WHERE label", marks=LABELS)
def el_rate_at_fpr(s, d):
    return r6(evaluate.rate_at_fpr(_labels(s, d), 0.01), "rate", "cut")


@query("SELECT round(corr(a, b), 6) AS spearman FROM (SELECT row_number() OVER (ORDER BY v, device_id) AS a, row_number() OVER (ORDER BY p, device_id) AS b FROM (SELECT device_id, round(avg(voltage), 6) AS v, round(avg(power), 6) AS p FROM telemetry GROUP BY device_id))")
def el_spearman(s, d):
    rows = get(s, d, "telemetry").groupBy("device_id").agg(F.round(F.avg("voltage"), 6).alias("v"), F.round(F.avg("power"), 6).alias("p"))
    return r6(evaluate.spearman(rows, "v", "p", "device_id"), "spearman")


@query("""
WITH RECURSIVE inside AS (SELECT b.zone, b.radius, b.centre, g.seed, any_value(b.size) AS m, any_value(b.n) AS n, count(*) FILTER (WHERE b.idx = g.idx) AS hit, count(DISTINCT g.idx) AS k
  FROM ball_members b JOIN (SELECT zone, centre AS seed, idx FROM ball1) g ON g.zone = b.zone GROUP BY b.zone, b.radius, b.centre, g.seed)
SELECT zone, seed, round(max(abs(hit / m - (k - hit) / (n - m)) / sqrt(1e0 / m + 1e0 / (n - m))), 6) AS reach FROM inside GROUP BY zone, seed""")
def el_reachable_contrast(s, d):
    """The largest contrast that any ball can extract from the group around each meter, in units of shift over effective spread."""
    groups = graph.k_hop(get(s, d, "edges"), get(s, d, "points"), 1).withColumnRenamed("centre", "seed")
    return r6(evaluate.reachable_contrast(groups, get(s, d, "balls")), "reach")


@query("SELECT zone, centre, idx, 1.5e0 * CASE WHEN device_id LIKE 'dev-tri%' THEN 20e0 ELSE 10e0 END AS delta FROM ball1 JOIN points USING (zone, idx)")
def el_deltas_by_seed(s, d):
    p = get(s, d, "points")
    rows = graph.k_hop(get(s, d, "edges"), p, 1).join(p.select("zone", "idx", "device_id"), ["zone", "idx"])
    return rows.select("zone", "centre", "idx", (F.lit(1.5) * F.when(F.col("device_id").startswith("dev-tri"), 20.0).otherwise(10.0)).alias("delta"))


@query(GROW.format(size=5, seed=2), wanted="SELECT zone, idx AS event, idx AS seed_idx FROM points")
def el_groups_by_seed(s, d):
    wanted = get(s, d, "points").select("zone", F.col("idx").alias("event"), F.col("idx").alias("seed_idx"), F.lit(5).alias("size"), F.lit("compact").alias("shape"))
    return inject.subgraphs(get(s, d, "edges"), wanted, seed=2)


@query(f"SELECT zone, round(max(statistic), 6) AS statistic FROM (SELECT zone, bin, max(abs(mean - 50e0)) / ({SIGMA}e0 / sqrt({LENGTH}e0)) AS statistic FROM means GROUP BY zone, bin) GROUP BY zone")
def el_threshold_signal(s, d):
    rows = detect.meter_threshold(get(s, d, "means"), 50.0, SIGMA, LENGTH)
    return rows.groupBy("zone").agg(F.round(F.max("statistic"), 6).alias("statistic"))


def _evaluation(s, d):
    from ..operators import experiments

    return experiments


for _name in ("el_signature", "el_detection_table", "el_mag_dur", "el_sliding_eval", "el_group_size", "el_shape_vs_magnitude", "el_rates", "el_advantage", "el_sliding_known", "el_radii", "el_tau", "el_individual", "el_mag_dur_cell"):

    def _grid(s, d, name=_name):
        return getattr(_evaluation(s, d), name)(get(s, d, "points"), get(s, d, "edges"), get(s, d, "balls"))

    _grid.__name__ = _name
    query()(_grid)


# --- the live path, replayed ---


@query(f"""
SELECT zone, bin, CASE WHEN partial = 0 THEN 'ventana' ELSE 'sin_datos' END AS status, CASE WHEN partial = 0 THEN NULL WHEN bin - {LENGTH - 1} < first THEN 'calentamiento' ELSE 'bins_incompletos' END AS reason,
  partial::INTEGER AS incomplete, missing, skipped::INTEGER AS skipped, CASE WHEN partial = 0 THEN round(total, 4) END AS total
FROM (SELECT t.zone, t.bin, any_value(skipped) AS skipped, any_value(first) AS first, count(DISTINCT b) FILTER (WHERE value IS NULL) AS partial, string_agg(DISTINCT m.device_id, ',' ORDER BY m.device_id) FILTER (WHERE value IS NULL) AS missing, sum(value) / {LENGTH} AS total
  FROM (SELECT *, unnest(generate_series(bin - {LENGTH - 1}, bin)) AS b FROM (SELECT zone, bin, coalesce(bin - lag(bin) OVER (PARTITION BY zone ORDER BY bin) - 1, 0) AS skipped, min(bin) OVER (PARTITION BY zone) AS first FROM (SELECT DISTINCT zone, bin FROM cells))) t
  JOIN (SELECT zone, device_id FROM meters) m USING (zone) LEFT JOIN cells c ON c.zone = t.zone AND c.bin = t.b AND c.device_id = m.device_id GROUP BY t.zone, t.bin)""")
def st_replay(s, d):
    """The streaming transition over the stored readings, one tick a bin."""
    total = F.aggregate("means", F.lit(0.0), lambda acc, x: acc + x)
    return _replayed(s, d).withColumn("total", F.round(total, 4)).drop("means")


# --- library operators for queries whose text is their SQL twin ---


@operator
def src_sim_daily(s, d):
    return get(s, d, "telemetry").select("id", F.round(simulator.daily_load(F.timestamp_micros("ts_us")), 6).alias("load"))


@operator
def src_sim_zone_cycle(s, d):
    rows = evaluate.numbered(get(s, d, "meters").select("device_id"), "device_id")
    letters = F.array(*map(F.lit, simulator.ZONE_CYCLE))
    cycle = F.element_at(letters, (F.pmod(F.col("place") - 1, F.lit(len(simulator.ZONE_CYCLE))) + 1).cast("int"))
    return rows.select("device_id", cycle.alias("cycle"), F.lpad(F.col("place").cast("string"), 5, "0").alias("number"))


@operator
def prj_status_tone(s, d):
    return get(s, d, "telemetry").select("id", registry.tone(F.col("status")).alias("tone"))


@operator
def prj_liveness(s, d):
    """Of all meters, and one that never sent a reading."""
    t = get(s, d, "telemetry")
    seen = registry.latest(t).select("device_id", F.col("arrival_us").alias("seen"))
    never = get(s, d, "meters").select(F.lit("dev-mon-99999999").alias("device_id")).limit(1)
    rows = readings.with_now(get(s, d, "meters").select("device_id").unionByName(never).join(seen, "device_id", "left"), t)
    age = readings.age_seconds(F.col("seen"), F.col("now"))
    return rows.select("device_id", registry.liveness(F.when(F.col("seen").isNotNull(), age), 86400, 259200).alias("liveness"))


@operator
def flt_zone_filter(s, d):
    return get(s, d, "meters").where(F.col("zone").isin(zone_filter(" z000001 ,z000003, "))).select("device_id", "zone")


@operator
def jn_latest_map(s, d):
    last = registry.latest(get(s, d, "telemetry"), by="ts_us").select("device_id", "value", "ts_us")
    return get(s, d, "meters").select("device_id").join(last, "device_id", "left")


@operator
def win_latest_per_key(s, d):
    return registry.latest(get(s, d, "telemetry"), by="ts_us").select("device_id", "id", "ts_us")


@operator
def agg_total_power_now(s, d):
    return registry.latest(get(s, d, "telemetry")).agg(F.round(F.sum("power"), 6).alias("power"))


@operator
def srt_recent_k(s, d):
    return registry.recent(get(s, d, "telemetry"), 100).select("id", "device_id", "arrival_us")


@operator
def srt_history_k(s, d):
    return registry.history(get(s, d, "telemetry"), "dev-mon-00000007", 100).select("id", "arrival_us")


@operator
def srt_latest_one(s, d):
    return registry.history(get(s, d, "telemetry"), "dev-mon-00000007", 1).select("id", "arrival_us")


@operator
def st_bin(s, d):
    at = windows.bin_of(F.col("ts_us"), windows.WindowConfig().bin_us)
    return get(s, d, "telemetry").select("id", at.alias("bin"), (at * windows.WindowConfig().bin_us).alias("start_us"))


@operator
def st_last_closed(s, d):
    return get(s, d, "telemetry").select("id", windows.last_closed(F.col("arrival_us"), windows.WindowConfig()).alias("last_closed"))


@operator
def st_cycle_interval(s, d):
    return s.range(1).select(F.lit(cycle_interval(6.0, 0.001394)).alias("interval"))


@operator
def agg_cells(s, d):
    return windows.cells(get(s, d, "telemetry"), GAPPY).select("zone", "device_id", "bin", "n")


@operator
def sc_clamp(s, d):
    return get(s, d, "telemetry").select("id", simulator.clamp(F.col("voltage"), 210.0, 230.0).alias("voltage"))


@operator
def gr_degree(s, d):
    return r6(graph.degrees(get(s, d, "edges")), "degree")


@operator
def agg_pooled_stats(s, d):
    t = get(s, d, "telemetry")
    cuts = evaluate.percentiles(t, "voltage", {"p1": 0.01, "p50": 0.5, "p99": 0.99}, "device_type")
    rest = t.groupBy("device_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("device_id").alias("meters"), F.round(F.avg("voltage"), 6).alias("mean"), F.round(F.stddev_samp("voltage"), 6).alias("sigma"), F.min("voltage").alias("least"), F.max("voltage").alias("most"))
    return rest.join(cuts, "device_type")


@operator
def agg_transport_delay(s, d):
    t = get(s, d, "telemetry").withColumn("delay", (F.col("arrival_us") - F.col("ts_us")) / 1e6)
    cuts = evaluate.percentiles(t, "delay", {"p50": 0.5, "p99": 0.99})
    return cuts.crossJoin(t.agg(F.min("delay").alias("least"), F.max("delay").alias("most")))


@operator
def win_interarrival(s, d):
    before = F.lag("ts_us").over(Window.partitionBy("device_id").orderBy("ts_us"))
    gaps = get(s, d, "telemetry").select("zone", ((F.col("ts_us") - before) / 1e6).alias("gap")).where("gap is not null")
    # a table: the gaps take a sort, and percentiles read them three times
    gaps = materialize(gaps, "gaps")
    ends = gaps.groupBy("zone").agg(F.min("gap").alias("least"), F.max("gap").alias("most"))
    return evaluate.percentiles(gaps, "gap", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "zone").join(ends, "zone")


from . import reads, reports  # noqa: E402, F401  register their queries
