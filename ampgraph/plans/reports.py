"""Queries that report on windows, detection and topology, with SQL twins written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import detect, evaluate, graph, inject, registry, sparse, spectral, windows
from ..sources import sinks, tables
from ..storage import materialize
from ..streaming import live, processor
from .analytics import PLACES, STATUS, WHOLE, WINNERS, _payload_parts, _plans, _whole, r6
from .registry import query
from .views import DAY_US, DUCK, FULL, GAPPY, LENGTH, SIGMA, THRESHOLD, get

WIDTHS = (2, 3, 5, 8)

# --- how whole windows are ---

REPORT = f"""
SELECT width, zone, any_value(n) AS n, count(*) AS bins, count(*) FILTER (WHERE present = n) AS full_bins, count(*) FILTER (WHERE present = 0) AS empty_bins, count(*) FILTER (WHERE present > 0 AND present < n) AS partial_bins,
  avg(CASE WHEN present = n THEN 1e0 ELSE 0e0 END) AS bin_share, coalesce(count(*) FILTER (WHERE place >= {LENGTH} AND run = {LENGTH}) / nullif(count(*) FILTER (WHERE place >= {LENGTH}), 0), 0e0) AS window_share,
  coalesce(quantile_cont(n - present, 0.5) FILTER (WHERE present > 0 AND present < n), 0e0) AS missing_p50, coalesce(quantile_cont(n - present, 0.95) FILTER (WHERE present > 0 AND present < n), 0e0) AS missing_p95,
  coalesce(max(n - present) FILTER (WHERE present > 0 AND present < n), 0) AS missing_most, any_value(cells) AS cells, any_value(multiple_cells) AS multiple_cells, any_value(multiple_cells) / any_value(cells) AS multiple_share,
  any_value(most_readings) AS most_readings, any_value(readings) AS readings
FROM (SELECT *, row_number() OVER w AS place, count(*) FILTER (WHERE present = n) OVER (w ROWS {LENGTH - 1} PRECEDING) AS run FROM (
    SELECT g.width, g.zone, g.bin, coalesce(b.present, 0) AS present, z.n, g.cells, g.multiple_cells, g.most_readings, g.readings
    FROM (SELECT width, zone, cells, multiple_cells, most_readings, readings, unnest(generate_series(lo + cut, hi - cut)) AS bin FROM (
        SELECT width, zone, min(bin) AS lo, max(bin) AS hi, CASE WHEN max(bin) - min(bin) > 1 THEN 1 ELSE 0 END AS cut, sum(present)::BIGINT AS cells, sum(multiple)::BIGINT AS multiple_cells, max(most) AS most_readings, sum(readings)::BIGINT AS readings FROM width_bins GROUP BY width, zone)) g
    LEFT JOIN width_bins b USING (width, zone, bin) JOIN (SELECT zone, count(*) AS n FROM meters GROUP BY zone) z ON z.zone = g.zone) WINDOW w AS (PARTITION BY width, zone ORDER BY bin))
GROUP BY width, zone"""
WIDTH_BINS = f"""
SELECT width, zone, bin, count(*) AS present, sum(k)::BIGINT AS readings, count(*) FILTER (WHERE k > 1) AS multiple, max(k) AS most
FROM (SELECT w * {DAY_US} AS width, zone, device_id, ts_us // (w * {DAY_US}) AS bin, count(*) AS k FROM telemetry, (VALUES {", ".join(f"({w})" for w in WIDTHS)}) AS g(w) GROUP BY ALL) GROUP BY width, zone, bin"""
WHOLENESS = {"report": REPORT, "width_bins": WIDTH_BINS}


def _report(s, d):
    return windows.completeness_report(get(s, d, "telemetry"), windows.zone_sizes(get(s, d, "meters")), [w * DAY_US for w in WIDTHS], LENGTH)


@query("SELECT width, zone, n, bins, full_bins, empty_bins, partial_bins, round(bin_share, 6) AS bin_share, round(window_share, 6) AS window_share, round(missing_p50, 6) AS missing_p50, round(missing_p95, 6) AS missing_p95, missing_most, cells, multiple_cells, round(multiple_share, 6) AS multiple_share, most_readings, readings FROM report", **WHOLENESS)
def agg_bin_completeness(s, d):
    return r6(_report(s, d), "bin_share", "window_share", "missing_p50", "missing_p95", "multiple_share")


@query(f"""
SELECT width, CASE WHEN worst >= 0.95 THEN 'target' ELSE 'best' END AS rule, round(worst, 6) AS worst, width * {LENGTH} AS window_us, (SELECT zone FROM report r WHERE r.width = q.width ORDER BY window_share, zone LIMIT 1) AS limiting_zone
FROM (SELECT width, min(window_share) AS worst FROM report GROUP BY width) q ORDER BY worst < 0.95, CASE WHEN worst >= 0.95 THEN width ELSE 0 END, worst DESC, width LIMIT 1""", **WHOLENESS)
def agg_choose_width(s, d):
    return r6(windows.choose_width(_report(s, d), LENGTH), "worst")


# --- the live cycle, replayed ---

CYCLES = f"""
SELECT zone, bin, CASE WHEN w.bin IS NULL AND status = 'ventana' THEN 'unscored' ELSE status END AS status, detected, round(statistic, 6) AS statistic, radius, centre FROM statuses_replayed LEFT JOIN winners_gappy w USING (zone, bin)
UNION ALL SELECT zone, NULL, 'sin_bin', NULL, NULL, NULL, NULL FROM statuses_replayed"""
GAPPY_SQL = {k: v.replace("cells_full", "cells").replace(" signal", " signal_gappy").replace(" means", " means_gappy") for k, v in DUCK.items() if k in ("signal", "means", "scores")}
REPLAYED = {
    "statuses_replayed": f"""
SELECT t.zone, t.bin, CASE WHEN bool_and(c.device_id IS NOT NULL) THEN 'ventana' ELSE 'sin_datos' END AS status
FROM (SELECT *, unnest(generate_series(bin - {LENGTH - 1}, bin)) AS b FROM (SELECT DISTINCT zone, bin FROM cells)) t JOIN (SELECT zone, device_id FROM meters) m ON m.zone = t.zone
LEFT JOIN cells c ON c.zone = t.zone AND c.bin = t.b AND c.device_id = m.device_id GROUP BY t.zone, t.bin""",
    "signal_gappy": GAPPY_SQL["signal"], "means_gappy": GAPPY_SQL["means"], "scores_gappy": GAPPY_SQL["scores"],
    "places_gappy": PLACES.replace("scores", "scores_gappy"), "winners_gappy": WINNERS.replace("FROM places", "FROM places_gappy"), "cycles": CYCLES,
}


def _cycles(s, d, zone=None):
    """Two ticks a bin: the first emits and is scanned, the second finds nothing new. A replay of one zone takes its devices alone."""
    own = F.lit(True) if zone is None else F.col("zone") == zone
    config = windows.WindowConfig(bin_us=GAPPY, length=LENGTH, grace_us=0)
    ticks = get(s, d, "cells").where(own).select("zone", F.explode(F.array(*(F.lit((1 * GAPPY) + x) for x in (10_000_000, 20_000_000)))).alias("__after"), "bin").select("zone", (F.col("bin") * GAPPY + F.col("__after")).alias("at_us")).distinct()
    rows = processor.replay(get(s, d, "telemetry"), get(s, d, "meters").where(own), ticks, config, idle=True)
    return r6(detect.scan(rows, _plans(s, d).where(own)), "statistic").select("zone", "bin", "status", "detected", "statistic", "radius", "centre")


@query("SELECT * FROM cycles WHERE zone = 'z000000'", **REPLAYED)
def st_run_zone(s, d):
    return _cycles(s, d, "z000000")


@query("SELECT status, count(*) AS n, count(*) FILTER (WHERE detected) AS detections FROM cycles GROUP BY status", **REPLAYED)
def st_run_cycle(s, d):
    return _cycles(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("detections"))


@query(f"SELECT id, device_id, arrival_us FROM telemetry WHERE arrival_us > (SELECT max(arrival_us) FROM telemetry) - {DAY_US}")
def st_live_tail(s, d):
    """The rule of the stream's tail, with the newest arrival as its clock."""
    t = get(s, d, "telemetry")
    rows = t.crossJoin(F.broadcast(t.agg(F.max("arrival_us").alias("now"))))
    return live.tail(rows, DAY_US / 1e6, F.col("now")).select("id", "device_id", "arrival_us")


# --- topology and thresholds ---

PRINTS = """
SELECT zone, substr(sha256('ampgraph-fp-2' || chr(10) || zone || chr(10) || n || chr(10) || ids || coalesce(chr(10) || pairs_text, '')), 1, 32) AS fingerprint
FROM (SELECT zone, count(*) AS n, string_agg(device_id, chr(10) ORDER BY idx) AS ids FROM points GROUP BY zone)
LEFT JOIN (SELECT zone, string_agg(src || '-' || dst, chr(10) ORDER BY src, dst) AS pairs_text FROM edges WHERE src < dst GROUP BY zone) USING (zone)"""


def _prints(s, d):
    return inject.fingerprints(get(s, d, "points"), get(s, d, "edges"))


@query("SELECT zone, fingerprint FROM prints WHERE zone = 'z000000'", prints=PRINTS)
def gr_fingerprint(s, d):
    one = F.col("zone") == "z000000"
    return inject.fingerprints(get(s, d, "points").where(one), get(s, d, "edges").where(one))


@query("SELECT zone, fingerprint FROM prints", prints=PRINTS)
def gr_fingerprints(s, d):
    return _prints(s, d)


@query("""
SELECT zone, 'missing' AS problem FROM (SELECT max(zone) AS zone FROM meters) UNION ALL SELECT 'gone', 'extra'
UNION ALL SELECT zone, 'changed' FROM (SELECT min(zone) AS zone, max(zone) AS last FROM meters) WHERE zone <> last""")
def jn_topology_full_outer(s, d):
    """Calibrated before the first zone lost a link, and without the last one; a zone that was calibrated is gone."""
    now, links = _prints(s, d), get(s, d, "edges")
    ends = get(s, d, "meters").agg(F.min("zone").alias("first"), F.max("zone").alias("last"))
    kept = links.crossJoin(F.broadcast(ends)).where("NOT (zone = first AND least(src, dst) = 0)").select(*links.columns)
    old = inject.fingerprints(get(s, d, "points"), kept).crossJoin(F.broadcast(ends)).where("zone <> last").select("zone", "fingerprint")
    old = old.unionByName(ends.select(F.lit("gone").alias("zone"), F.lit("00").alias("fingerprint")))
    with_rest = lambda x: x.withColumns({"sigma": F.lit(1.0), "window": F.lit(16)})
    return detect.check_frozen(with_rest(old).withColumn("threshold", F.lit(4.0)), with_rest(now))


@query(f"SELECT zone, CASE WHEN n % 2 = 0 THEN {LENGTH} ELSE {LENGTH + 1} END AS threshold_window, {LENGTH} AS bin_window, n % 2 = 0 AS fits FROM (SELECT zone, count(*) AS n FROM meters WHERE active GROUP BY zone)")
def dt_window_fit(s, d):
    """Thresholds of zones with an odd number of active meters were frozen for a longer window."""
    n = get(s, d, "meters").where("active").groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    frozen = n.select("zone", F.when(F.col("n") % 2 == 0, F.lit(LENGTH)).otherwise(F.lit(LENGTH + 1)).alias("window"))
    return windows.check_fit(frozen, n.select("zone", F.lit(LENGTH).alias("length")))


@query("SELECT zone, bin, idx, round(mean - sqrt(degree) * sum(mean * sqrt(degree)) OVER w / sum(degree) OVER w, 6) AS value FROM means JOIN degrees USING (zone, idx) WINDOW w AS (PARTITION BY zone, bin)")
def dt_prepare(s, d):
    return r6(detect.prepare(get(s, d, "means"), get(s, d, "edges"), project=True).withColumnRenamed("mean", "value"), "value")


@query()
def dt_prepare_diffused(s, d):
    return r6(detect.prepare(get(s, d, "means"), get(s, d, "edges"), tau=0.5, project=True), "mean")


# --- verdicts over detection rates ---

CUTS, LENGTHS = (1.0, 1.5, 2.0, 3.0), (1, 2, 4)


def _lengths_sql() -> dict[str, str]:
    """Rates by cut and window length: means and scores of each length, from the texts of the views for one."""
    out, parts = {}, []
    for n in LENGTHS:
        out[f"means_of_{n}"] = DUCK["means"].replace(f"RANGE BETWEEN {LENGTH - 1} PRECEDING", f"RANGE BETWEEN {n - 1} PRECEDING").replace(f"filled = {LENGTH}", f"filled = {n}")
        out[f"scores_of_{n}"] = DUCK["scores"].replace("means", f"means_of_{n}").replace(f"sqrt({LENGTH}e0)", f"sqrt({n}e0)")
        parts.append(f"""SELECT {n} AS length, zone, bin, best, meter FROM (SELECT zone, bin, max(statistic) AS best FROM scores_of_{n} GROUP BY zone, bin)
JOIN (SELECT zone, bin, max(abs(mean - 50e0)) / ({SIGMA}e0 / sqrt({n}e0)) AS meter FROM means_of_{n} GROUP BY zone, bin) USING (zone, bin)""")
    out["rates"] = f"SELECT cut, length, avg(CASE WHEN best > cut THEN 1e0 ELSE 0e0 END) AS scan, avg(CASE WHEN meter > cut THEN 1e0 ELSE 0e0 END) AS meter FROM ({' UNION ALL '.join(parts)}), (VALUES {', '.join(f'({c}e0)' for c in CUTS)}) AS g(cut) GROUP BY cut, length"
    return out


RATES = _lengths_sql()


def _rates(s, d) -> DataFrame:
    """(cut, length, scan, meter): the shares of windows that the ball scan and the largest single meter put above each cut."""
    cells, points, balls = get(s, d, "cells_full"), get(s, d, "points"), get(s, d, "balls")
    out = None
    for n in LENGTHS:
        means = windows.dense_means(cells, points, n)
        zones = balls.select("zone").distinct().select("zone", F.lit(0.0).alias("threshold"), F.lit(SIGMA).alias("sigma"), F.lit(n).alias("window"))
        best = detect.scan(detect.mean_arrays(means), detect.plans(balls, zones)).select("zone", "bin", F.col("statistic").alias("best"))
        both = best.join(detect.meter_threshold(means, 50.0, SIGMA, n).withColumnRenamed("statistic", "meter"), ["zone", "bin"]).withColumn("length", F.lit(n))
        out = both if out is None else out.unionByName(both)
    over = out.withColumn("cut", F.explode(F.array(*map(F.lit, CUTS))))
    share = lambda c: F.avg((F.col(c) > F.col("cut")).cast("double")).alias({"best": "scan"}.get(c, c))
    return over.groupBy("cut", "length").agg(share("best"), share("meter"))


@query("""
SELECT cut, min(CASE WHEN next_length <= 2 * length AND next_scan - scan < 0.05e0 THEN length END) AS flat
FROM (SELECT cut, length, scan, lead(length) OVER w AS next_length, lead(scan) OVER w AS next_scan FROM rates WINDOW w AS (PARTITION BY cut ORDER BY length)) GROUP BY cut""", **RATES)
def win_flattening(s, d):
    return evaluate.flattening(_rates(s, d))


@query("""
SELECT cut, length, round(CASE WHEN meter > 0 THEN scan / meter ELSE 'inf'::DOUBLE END, 6) AS ratio, round(scan - meter, 6) AS difference, (meter = 0 OR scan / meter >= 2) AND scan - meter >= 0.2e0 AS wins
FROM rates WHERE scan >= 0.5e0 ORDER BY cut, length LIMIT 1""", **RATES)
def el_criteria(s, d):
    return r6(evaluate.criteria(_rates(s, d), power=0.5), "ratio", "difference")


@query("""
SELECT cut, first(length ORDER BY scan - meter DESC, length) FILTER (WHERE scan >= 0.5e0) AS by_advantage, first(length ORDER BY scan DESC, length) AS by_detection,
  first(length ORDER BY scan - meter DESC, length) FILTER (WHERE scan >= 0.5e0) IS DISTINCT FROM first(length ORDER BY scan DESC, length) AS differ FROM rates GROUP BY cut""", **RATES)
def el_pick_window(s, d):
    return evaluate.pick_window(_rates(s, d))


CURVE = "SELECT bin AS x, max(m) / min(m) AS dispersion, min(m) / max(m) AS retained FROM (SELECT zone, bin, avg(value) AS m FROM cells GROUP BY zone, bin) GROUP BY bin"


@query("SELECT min(x) FILTER (WHERE dispersion <= 1.5e0) AS lower, max(x) FILTER (WHERE retained <= 0.5e0) AS upper FROM curve", curve=CURVE)
def win_knees(s, d):
    """The rule over a curve of the tables: how far zones' means lie apart in each bin."""
    m = get(s, d, "cells").groupBy("zone", "bin").agg(F.avg("value").alias("m"))
    curve = m.groupBy(F.col("bin").alias("x")).agg((F.max("m") / F.min("m")).alias("dispersion"), (F.min("m") / F.max("m")).alias("retained"))
    return evaluate.knees(curve)


# --- reads ---


@query("""
SELECT device_id, coalesce(n_name, zone) AS label FROM meters LEFT JOIN nation ON 'z' || lpad((n_nationkey * 2)::VARCHAR, 6, '0') = zone""")
def prj_zone_label(s, d):
    """Every second zone is named after a nation, the others keep their key."""
    key = F.concat(F.lit("z"), F.lpad((F.col("n_nationkey") * 2).cast("string"), 6, "0"))
    labels = tables.table(s, d, "nation").select(key.alias("zone"), F.col("n_name").alias("label"))
    return registry.labelled_zones(get(s, d, "meters"), labels).select("device_id", "label")


SIGNS = f"""
SELECT z.zone, t.newest >= (SELECT max(ts_us) FROM telemetry) - {DAY_US} AS db, CASE WHEN t.n >= 100 THEN t.faults * 5 < t.n END AS broker, z.zone LIKE '%3' AS failed
FROM (SELECT DISTINCT zone FROM meters) z LEFT JOIN (SELECT zone, max(ts_us) AS newest, count(*) AS n, count(*) FILTER (WHERE status = 'falla') AS faults FROM telemetry GROUP BY zone) t USING (zone)"""


def _signs(s, d):
    """(zone, db, broker, failed): a zone's parts as its readings tell: fresh within a day, few faults (unknown under 100 readings), one request failed."""
    t = get(s, d, "telemetry")
    seen = t.groupBy("zone").agg(F.max("ts_us").alias("newest"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "falla").alias("faults"))
    rows = get(s, d, "meters").select("zone").distinct().join(seen, "zone", "left").crossJoin(F.broadcast(t.agg(F.max("ts_us").alias("last"))))
    broker = F.when(F.col("n") >= 100, F.col("faults") * 5 < F.col("n"))
    return rows.select("zone", (F.col("newest") >= F.col("last") - DAY_US).alias("db"), broker.alias("broker"), F.col("zone").endswith("3").alias("failed"))


@query("SELECT zone, CASE WHEN failed THEN 'down' WHEN db IS NULL OR broker IS NULL THEN 'unknown' WHEN db AND broker THEN 'ok' ELSE 'down' END AS health FROM signs", signs=SIGNS)
def prj_health(s, d):
    return _signs(s, d).select("zone", registry.health(F.col("db"), F.col("broker"), F.col("failed")).alias("health"))


@query("SELECT zone, CASE WHEN coalesce(db, FALSE) AND coalesce(broker, FALSE) THEN 'ok' ELSE 'degraded' END AS health FROM signs", signs=SIGNS)
def prj_health_api(s, d):
    return _signs(s, d).select("zone", registry.health_of_server(F.col("db"), F.col("broker")).alias("health"))


@query("""
SELECT id, (s IS NULL) <> (f IS NULL) AND (p IS NULL) <> (z IS NULL) AND start >= 0 AND duration >= 1 AND coalesce(p, 0) >= 0 AND coalesce(z, 1) >= 1 AND direction <> 0 AND shape <> 'round' AS valid
FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 1.5e0 END AS s, CASE WHEN id % 3 <> 0 THEN 0.1e0 END AS f, CASE WHEN id % 5 < 2 THEN id % 7 - 1 END AS p, CASE WHEN id % 5 > 0 THEN id % 4 END AS z, id % 11 - 1 AS start, id % 6 AS duration, id % 3 - 1 AS direction,
  CASE WHEN id % 13 = 0 THEN 'round' WHEN id % 2 = 0 THEN 'compact' ELSE 'extended' END AS shape FROM telemetry)""")
def flt_spec(s, d):
    """Events made of readings' ids, of which some break each rule."""
    i, null = F.col("id"), F.lit(None)
    rows = get(s, d, "telemetry").select(
        "id", F.when(i % 2 == 0, 1.5).alias("sigma_multiple"), F.when(i % 3 != 0, 0.1).alias("fraction"), F.when(i % 5 < 2, i % 7 - 1).otherwise(null).alias("depth"), F.when(i % 5 > 0, i % 4).alias("size_target"),
        (i % 11 - 1).alias("start"), (i % 6).alias("duration"), (i % 3 - 1).alias("direction"), F.when(i % 13 == 0, "round").when(i % 2 == 0, "compact").otherwise("extended").alias("shape"), F.lit("raise").alias("on_violation"),
    )
    return rows.select("id", inject.valid_spec().alias("valid"))


FLAT = "SELECT zone, lon * 110899e0 AS x, lat * 110574e0 AS y FROM meters"


@query("""
SELECT za, zb, round(sqrt(pow(c.x - e.x, 2e0) + pow(c.y - e.y, 2e0)), 4) AS centroids, nearest FROM (SELECT a.zone AS za, b.zone AS zb, round(min(sqrt(pow(a.x - b.x, 2e0) + pow(a.y - b.y, 2e0))), 4) AS nearest FROM flat a JOIN flat b ON a.zone < b.zone GROUP BY a.zone, b.zone)
JOIN (SELECT zone, avg(x) AS x, avg(y) AS y FROM flat GROUP BY zone) c ON c.zone = za JOIN (SELECT zone, avg(x) AS x, avg(y) AS y FROM flat GROUP BY zone) e ON e.zone = zb""", flat=FLAT)
def jn_zone_pairs(s, d):
    flat = get(s, d, "meters").select("zone", (F.col("lon") * F.lit(110899.0)).alias("x"), (F.col("lat") * F.lit(110574.0)).alias("y"))
    rows = registry.zone_pairs(flat)
    return rows.withColumns({c: F.round(c, 4) for c in ("centroids", "nearest")})


# --- filters over the stored signal ---


@query()
def sp_tau_sweep(s, d):
    """What diffusion leaves at each tau: mean, range and dispersion over zones, and the bands' shares."""
    rows = spectral.tau_sweep(get(s, d, "edges"), _whole(s, d), (0.1, 0.25, 0.5, 1.0, 2.0)).groupBy("tau")
    return rows.agg(F.avg("retained").alias("mean"), F.min("retained").alias("least"), F.max("retained").alias("most"), F.try_divide(F.max("retained"), F.min("retained")).alias("dispersion"), F.avg("high_retained").alias("high"), F.avg("low_retained").alias("low"))


@query("SELECT DISTINCT zone, TRUE AS collapses, TRUE AS stays FROM whole", whole=WHOLE)
def sp_limits(s, d):
    """At a small tau the square roots of degrees are left, at a large one the signal."""
    rows = spectral.limits(get(s, d, "edges"), _whole(s, d))
    return rows.select("zone", (F.col("to_kernel") > 1 - 1e-6).alias("collapses"), ((F.col("to_identity") > 1 - 1e-6) & (F.col("error") < 1e-2)).alias("stays"))


@query()
def sp_sign_compare(s, d):
    """Dirichlet and band energies of the signal, and under either sign of the exponent."""
    e, x = get(s, d, "edges"), materialize(_whole(s, d), "signal")
    out = None
    for name, sign in {"original": 0, "negative": -1, "positive": 1}.items():
        y = materialize(spectral.diffuse(e, x, 0.5, sign=sign), "signal") if sign else x
        bands = spectral.band_energy(e, y).groupBy("zone").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
        row = spectral.dirichlet(y, e).groupBy("zone").agg(F.sum("energy").alias("energy")).join(bands, "zone").withColumn("filter", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.withColumns({c: F.round(c, 3) for c in ("energy", "low", "high")})


@query()
def sp_subtle_compare(s, d):
    """Which of three scores puts two changed nodes first: nodes 2 and 5, tripled (strong) or 5 % up (subtle)."""
    e, x = get(s, d, "edges"), _whole(s, d)
    own = F.col("idx").isin(2, 5)
    two = Window.partitionBy("zone", "t").orderBy(F.desc(F.round("score", 9)), "idx")
    out = None
    for name, factor in (("strong", 3.0), ("subtle", 1.05)):
        y = x.withColumn("value", F.when(own, F.col("value") * factor).otherwise(F.col("value")))
        smooth = y.join(spectral.diffuse(e, y, 0.5).withColumnRenamed("value", "__smooth"), ["zone", "t", "idx"]).select("zone", "t", "idx", F.abs(F.col("value") - F.col("__smooth")).alias("score"))
        over = Window.partitionBy("zone", "t")
        z = y.select("zone", "t", "idx", F.abs((F.col("value") - F.avg("value").over(over)) / F.greatest(F.stddev_pop("value").over(over), F.lit(1e-12))).alias("score"))
        modes = spectral.top_mode_score(e, y).withColumnRenamed("value", "score")
        for kind, rows in (("smooth", smooth), ("z", z), ("modes", modes)):
            best = rows.withColumn("place", F.row_number().over(two)).where("place <= 2").groupBy("zone", "t").agg(F.count_if(own).alias("hits"))
            row = best.groupBy("zone").agg(F.count(F.lit(1)).alias("instants"), F.count_if(F.col("hits") == 2).alias("both"), F.count_if(F.col("hits") > 0).alias("any")).select("zone", F.lit(name).alias("change"), F.lit(kind).alias("score"), "instants", "both", "any")
            out = row if out is None else out.unionByName(row)
    return out


@query()
def el_payload_bytes(s, d):
    """Bytes of the whole bodies by how many places of the ranking they keep; null: all."""
    parts, out = [materialize(x, "bodies") for x in _payload_parts(s, d)], None
    for k in (0, 1, 5, 10, None):
        size = sinks.window_payload(*parts, (F.col("bin") + 1) * FULL, top_k=k).agg(F.max(F.octet_length("value")).alias("most"), F.sum(F.octet_length("value")).alias("total"), F.count(F.lit(1)).alias("bodies")).withColumn("k", F.lit(k).cast("int"))
        out = size if out is None else out.unionByName(size)
    return out


# --- ingest and registry ---

NEWER = "SELECT id, device_id, zone, arrival_us, CASE WHEN id % 3 <> 0 THEN device_type END AS device_type, CASE WHEN id % 5 = 0 THEN node END AS node FROM telemetry"
FOLDED = "SELECT device_id, max_by(device_type, id) FILTER (WHERE device_type IS NOT NULL) AS device_type, max_by(zone, id) AS zone, max_by(node, id) FILTER (WHERE node IS NOT NULL) AS node, max_by(arrival_us, id) AS last_seen_us FROM newer WHERE {} GROUP BY device_id"


@query("""
SELECT device_id, coalesce(b.device_type, a.device_type) AS device_type, coalesce(b.zone, a.zone) AS zone, coalesce(b.node, a.node) AS node, coalesce(b.last_seen_us, a.last_seen_us) AS last_seen_us, TRUE AS active
FROM first_half a FULL JOIN second_half b USING (device_id)""", newer=NEWER, first_half=FOLDED.format("id % 4 <> 3"), second_half=FOLDED.format("id % 4 = 3"))
def snk_merge_registry(s, d):
    """A registry with a later batch's fold on top."""
    t = get(s, d, "telemetry").withColumns({"device_type": F.when(F.col("id") % 3 != 0, F.col("device_type")), "node": F.when(F.col("id") % 5 == 0, F.col("node"))})
    parts = [registry.upsert(t.where(cond)) for cond in ("id % 4 <> 3", "id % 4 = 3")]
    return registry.merge(parts[0], parts[1])


@query("SELECT m.zone AS registered_zone, count(*) AS n, count(*) FILTER (WHERE t.id % 5 = 0) AS misrouted FROM telemetry t JOIN meters m USING (device_id) WHERE m.active GROUP BY m.zone")
def jn_registered_zone(s, d):
    """Zones come from the registry: every fifth reading names another."""
    t = get(s, d, "telemetry").withColumn("zone", F.when(F.col("id") % 5 == 0, "elsewhere").otherwise(F.col("zone")))
    known, _ = registry.with_zone(t, get(s, d, "meters").where("active"))
    return known.groupBy("registered_zone").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("zone") == "elsewhere").alias("misrouted"))


REASONS = """
SELECT t.id, CASE WHEN id % 19 = 0 THEN 'json' WHEN id % 17 = 0 THEN 'field' WHEN id % 13 = 0 THEN 'naive_time' WHEN id % 11 = 0 THEN 'value' WHEN m.device_id IS NULL THEN 'unknown' ELSE 'accepted' END AS reason, m.zone
FROM telemetry t LEFT JOIN (SELECT device_id, zone FROM meters WHERE active) m USING (device_id)"""


@query("SELECT reason, CASE WHEN reason IN ('accepted') THEN zone END AS zone, count(*) AS n FROM reasons GROUP BY ALL", reasons=REASONS)
def st_ingest_reasons(s, d):
    """Messages made of all readings, broken in each way: what is accepted for which zone, and why the rest is not."""
    i = F.col("id")
    stamp = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    time = F.when(i % 13 == 0, stamp).otherwise(F.concat(stamp, F.lit("+00:00")))
    body = F.to_json(F.struct("device_id", time.alias("timestamp_utc"), F.lit("elsewhere").alias("zone"), F.when(i % 17 == 0, None).when(i % 11 == 0, "much").otherwise(F.col("voltage").cast("string")).alias("voltage")))
    raw = get(s, d, "telemetry").select("arrival_us", F.when(i % 19 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("value"))
    good, bad = live.read_messages(raw, get(s, d, "meters").where("active"), "voltage")
    rows = good.select(F.lit("accepted").alias("reason"), "zone").unionByName(bad.select("reason", F.lit(None).cast("string").alias("zone")))
    return rows.groupBy("reason", "zone").agg(F.count(F.lit(1)).alias("n"))


# --- diffusion without a matrix ---

TERMS = 20
TAYLOR = {
    "scaled": "SELECT e.zone, e.src, e.dst, weight / sqrt(a.degree * b.degree) AS share FROM edges e JOIN degrees a ON a.zone = e.zone AND a.idx = e.src JOIN degrees b ON b.zone = e.zone AND b.idx = e.dst",
    "term0": "SELECT zone, t, idx, value AS v FROM whole",
} | {
    f"term{k}": f"SELECT x.zone, x.t, x.idx, any_value(x.v) / -{k}e0 + coalesce(sum(s.share * y.v), 0e0) / {k}e0 AS v FROM term{k - 1} x LEFT JOIN scaled s ON s.zone = x.zone AND s.src = x.idx LEFT JOIN term{k - 1} y ON y.zone = s.zone AND y.t = x.t AND y.idx = s.dst GROUP BY x.zone, x.t, x.idx"
    for k in range(1, TERMS + 1)
}


@query("""
SELECT zone, t, round(sum(x * x), 1) AS energy, round(sum(x * y), 1) AS dirichlet, round(sum(y * y), 1) AS second
FROM (SELECT x.zone, x.t, x.idx, any_value(x.value) AS x, any_value(x.value) - coalesce(sum(s.share * n.value), 0e0) AS y FROM whole x
  LEFT JOIN scaled s ON s.zone = x.zone AND s.src = x.idx LEFT JOIN whole n ON n.zone = s.zone AND n.t = x.t AND n.idx = s.dst GROUP BY x.zone, x.t, x.idx) GROUP BY zone, t""", whole=WHOLE, scaled=TAYLOR["scaled"])
def sp_gft(s, d):
    """Coefficients by their moments: squares weighted with 1, the eigenvalue and its square are x'x, x'Lx and x'LLx."""
    e, x = get(s, d, "edges"), _whole(s, d)
    values = spectral.spectrum(e).select("zone", F.col("k").alias("idx"), "eigenvalue")
    c = spectral.gft(e, x).join(values, ["zone", "idx"])
    square, own = F.col("value") * F.col("value"), F.col("eigenvalue")
    return c.groupBy("zone", "t").agg(F.round(F.sum(square), 1).alias("energy"), F.round(F.sum(square * own), 1).alias("dirichlet"), F.round(F.sum(square * own * own), 1).alias("second"))


@query(f"SELECT zone, t, idx, round(sum(v), 4) AS value FROM ({' UNION ALL '.join(f'SELECT * FROM term{k}' for k in range(TERMS + 1))}) GROUP BY zone, t, idx", whole=WHOLE, **TAYLOR)
def sp_diffuse_sparse(s, d):
    """The exponential of the Laplacian by Chebyshev terms over edges (2 for the largest eigenvalue); its twin sums Taylor terms."""
    points = get(s, d, "points")
    tops = points.select("zone").distinct().withColumn("largest", F.lit(2.0))
    return sparse.diffuse(points, get(s, d, "edges"), _whole(s, d), tau=0.5, largest=tops).withColumn("value", F.round("value", 4))
