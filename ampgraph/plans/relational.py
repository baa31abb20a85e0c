"""Relational queries, each one plan text for Spark (and, as it is, for the SQL check). ``{name}`` is a relation of views."""

NOW = "(SELECT max(arrival_us) FROM {telemetry})"
LAST_TS = "(SELECT max(ts_us) FROM {telemetry})"

SHARED = {
    # --- sources, projections, predicates ---
    "src_meters_sql": "SELECT device_id, zone, lat, lon FROM {meters} WHERE coalesce(active, TRUE) AND zone IN ('z000000', 'z000002')",
    "src_sim_daily": "SELECT id, round(sin(2 * pi() * ((ts_us / 3600e6) % 24e0 - 13e0) / 24e0), 6) AS load FROM {telemetry}",
    "src_sim_zone_cycle": "SELECT device_id, CASE CAST(row_number() OVER (ORDER BY device_id) - 1 AS BIGINT) % 10 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'a' WHEN 4 THEN 'd' WHEN 5 THEN 'e' WHEN 6 THEN 'a' WHEN 7 THEN 'f' WHEN 8 THEN 'b' ELSE 'c' END AS cycle, lpad(CAST(row_number() OVER (ORDER BY device_id) AS VARCHAR(10)), 5, '0') AS number FROM {meters}",
    "prj_rest_telemetry": "SELECT id AS reading_id, device_id AS meter_id, device_type AS kind, zone AS zone_id, ts_us AS event_time, voltage AS voltage_v, current AS current_a, power AS power_kw, energy AS energy_kwh, frequency AS frequency_hz, power_factor AS pf, status AS state, node AS origin, arrival_us AS received_at FROM {telemetry}",
    "prj_rest_meters": "SELECT device_id AS meter_id, device_type AS kind, zone AS zone_id, lat AS latitude, lon AS longitude, node AS origin, installed_us AS installed_at, last_seen_us AS last_seen_at, active AS is_active FROM {meters}",
    "flt_active_meters": "SELECT device_id, zone FROM {meters} WHERE active",
    "flt_bounds": "SELECT id, voltage, voltage NOT BETWEEN 205 AND 235 AS outside FROM {telemetry}",
    "flt_fresh_window": f"SELECT id, device_id FROM {{telemetry}} WHERE arrival_us >= {NOW} - 86400000000",
    "flt_zone_filter": "SELECT device_id, zone FROM {meters} WHERE zone IN (SELECT trim(z) FROM (SELECT ' z000001 ' AS z UNION ALL SELECT 'z000003' UNION ALL SELECT ' ') q WHERE trim(z) <> '')",
    "prj_status_tone": "SELECT id, CASE WHEN status IS NULL THEN 'neutral' WHEN status = 'activo' THEN 'success' WHEN status = 'mantenimiento' THEN 'warning' ELSE 'danger' END AS tone FROM {telemetry}",
    "prj_status_label": "SELECT id, coalesce(replace(status, '_', ' '), 'Sin clasificar') AS label FROM {telemetry}",
    "prj_age_seconds": f"SELECT device_id, greatest(0e0, ({NOW} - last_seen_us) / 1e6) AS age FROM {{meters}}",
    "prj_liveness": f"SELECT m.device_id, CASE WHEN age IS NULL THEN 'no reading' WHEN age < 86400 THEN 'live' WHEN age < 259200 THEN 'delayed' ELSE 'no signal' END AS liveness FROM (SELECT device_id FROM {{meters}} UNION ALL SELECT 'dev-mon-99999999') m LEFT JOIN (SELECT device_id, greatest(0e0, ({NOW} - max(arrival_us)) / 1e6) AS age FROM {{telemetry}} GROUP BY device_id) a ON m.device_id = a.device_id",
    "prj_freshness": f"SELECT zone, CASE WHEN ({NOW} - max(arrival_us)) / 1e6 > 60 THEN 'stale' ELSE 'live' END AS freshness FROM {{telemetry}} GROUP BY zone",
    "prj_device_type": "SELECT device_id, CASE substr(device_id, 5, 3) WHEN 'mon' THEN 'monofasico' WHEN 'tri' THEN 'trifasico' END AS kind FROM {meters}",
    # --- joins ---
    "jn_silent_anti": f"SELECT m.zone, count(*) AS silent FROM {{meters}} m LEFT JOIN (SELECT DISTINCT device_id FROM {{telemetry}} WHERE arrival_us >= {NOW} - 86400000000) s ON m.device_id = s.device_id WHERE s.device_id IS NULL GROUP BY m.zone",
    "jn_zone_type_profile": "SELECT m.device_id, m.zone, p.sigma FROM {meters} m JOIN (SELECT device_type, round(stddev_samp(voltage), 6) AS sigma FROM {telemetry} GROUP BY device_type) p ON m.device_type = p.device_type",
    "jn_threshold_zone": "SELECT z.zone, t.cut FROM (SELECT DISTINCT zone FROM {meters}) z JOIN (SELECT zone, round(avg(value), 6) AS cut FROM {telemetry} GROUP BY zone) t ON z.zone = t.zone",
    "jn_latest_map": "SELECT m.device_id, l.value, l.ts_us FROM {meters} m LEFT JOIN (SELECT * FROM (SELECT device_id, value, ts_us, row_number() OVER (PARTITION BY device_id ORDER BY ts_us DESC, id DESC) AS r FROM {telemetry}) q WHERE r = 1) l ON m.device_id = l.device_id",
    "jn_device_zone": "SELECT m.zone, count(*) AS known FROM {telemetry} t JOIN {meters} m ON t.device_id = m.device_id WHERE m.active GROUP BY m.zone",
    # --- aggregations ---
    "agg_horizon": "SELECT max(ts_us) AS until, max(ts_us) - 24 * 3600000000 AS since FROM {telemetry}",
    "agg_spatial_sigma": "SELECT device_type, count(*) AS instants, round(avg(n), 6) AS meters_per_instant, round(avg(m), 6) AS mean, round(sqrt(avg(v)), 6) AS sigma FROM (SELECT device_type, CAST(floor(ts_us / 86400e6) AS BIGINT) AS at, count(*) AS n, avg(voltage) AS m, var_samp(voltage) AS v FROM {telemetry} GROUP BY device_type, CAST(floor(ts_us / 86400e6) AS BIGINT) HAVING count(*) >= 10) q GROUP BY device_type",
    "agg_pooled_stats": "SELECT device_type, count(*) AS n, count(DISTINCT device_id) AS meters, round(avg(voltage), 6) AS mean, round(stddev_samp(voltage), 6) AS sigma, min(voltage) AS least, percentile_cont(0.01) WITHIN GROUP (ORDER BY voltage) AS p1, percentile_cont(0.5) WITHIN GROUP (ORDER BY voltage) AS p50, percentile_cont(0.99) WITHIN GROUP (ORDER BY voltage) AS p99, max(voltage) AS most FROM {telemetry} GROUP BY device_type",
    "agg_zone_type": "SELECT zone, device_type, count(DISTINCT device_id) AS meters FROM {telemetry} GROUP BY zone, device_type",
    "agg_registry_by_zone": "SELECT zone, count(*) AS meters FROM {meters} WHERE active AND zone IS NOT NULL GROUP BY zone",
    "agg_seen_by_zone": f"SELECT zone, count(DISTINCT device_id) AS seen FROM {{telemetry}} WHERE ts_us >= {LAST_TS} - 172800000000 AND ts_us < {LAST_TS} GROUP BY zone",
    "agg_transport_delay": "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY (arrival_us - ts_us) / 1e6) AS p50, percentile_cont(0.99) WITHIN GROUP (ORDER BY (arrival_us - ts_us) / 1e6) AS p99, min(arrival_us - ts_us) / 1e6 AS least, max(arrival_us - ts_us) / 1e6 AS most FROM {telemetry}",
    "agg_cells": "SELECT zone, device_id, CAST(floor(ts_us / 259200e6) AS BIGINT) AS bin, count(*) AS n FROM {telemetry} GROUP BY zone, device_id, CAST(floor(ts_us / 259200e6) AS BIGINT)",
    "agg_bins": "SELECT zone, bin, count(*) AS meters, CAST(sum(n) AS BIGINT) AS readings, count(*) FILTER (WHERE n > 1) AS multiple, max(n) AS most FROM {cells} GROUP BY zone, bin",
    "agg_zone_counts": "SELECT coalesce(zone, '(sin zona)') AS zone, count(*) AS meters FROM {meters} GROUP BY coalesce(zone, '(sin zona)') ORDER BY meters",
    "agg_total_power_now": "SELECT round(sum(power), 6) AS power FROM (SELECT power, row_number() OVER (PARTITION BY device_id ORDER BY arrival_us DESC, id DESC) AS r FROM {telemetry}) q WHERE r = 1",
    "agg_ingest_rate": "SELECT zone, CASE WHEN count(*) < 2 OR max(arrival_us) <= min(arrival_us) THEN 0e0 ELSE (count(*) - 1) / ((max(arrival_us) - min(arrival_us)) / 1e6) END AS rate FROM {telemetry} GROUP BY zone",
    "agg_msg_rate": "SELECT zone, CASE WHEN max(ts_us) > min(ts_us) THEN count(*) / ((max(ts_us) - min(ts_us)) / 1e6) END AS rate FROM {telemetry} GROUP BY zone",
    "agg_last_hour": f"SELECT count(*) AS n FROM (SELECT arrival_us FROM {{telemetry}} ORDER BY arrival_us DESC, id DESC LIMIT 1000) q WHERE arrival_us >= {NOW} - 3600000000",
    "agg_active_10s": f"SELECT count(*) FILTER (WHERE ({NOW} - last_seen_us) / 1e6 < 86400) AS active FROM {{meters}}",
    "agg_newest": "SELECT id, device_id, ts_us FROM {telemetry} ORDER BY ts_us DESC, id LIMIT 1",
    "agg_group_mean": "SELECT status, round(avg(voltage), 6) AS voltage, round(avg(power), 6) AS power, round(avg(energy), 6) AS energy FROM {telemetry} GROUP BY status ORDER BY status NULLS LAST",
    "agg_mean_by_key": "SELECT node, round(avg(current), 6) AS current, round(avg(frequency), 6) AS frequency FROM {telemetry} GROUP BY node ORDER BY node",
    "agg_mean_by_pair": "SELECT node, device_type, round(avg(power), 6) AS power, round(avg(voltage), 6) AS voltage FROM {telemetry} GROUP BY node, device_type",
    "agg_mean_optional": "SELECT zone, round(avg(energy), 6) AS energy, count(energy) AS filled FROM {telemetry} GROUP BY zone",
    "agg_cycle_percentiles": "SELECT zone, round(avg(value), 6) AS mean, max(value) AS most, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS p50, max(CASE WHEN r = CAST(floor(0.95e0 * (n - 1)) AS BIGINT) + 1 THEN value END) AS p95, max(CASE WHEN r = CAST(floor(0.99e0 * (n - 1)) AS BIGINT) + 1 THEN value END) AS p99 FROM (SELECT zone, value, row_number() OVER (PARTITION BY zone ORDER BY value, id) AS r, count(*) OVER (PARTITION BY zone) AS n FROM {telemetry}) q GROUP BY zone",
    "agg_zone_bbox_density": "SELECT zone, round(count(*) / ((max(x) - min(x)) / 1000 * (max(y) - min(y)) / 1000), 6) AS density FROM {points} GROUP BY zone",
    "agg_zone_diameter": "SELECT zone, round(max(dist), 6) AS diameter FROM {pairs} GROUP BY zone",
    "agg_corr": "SELECT zone, round(corr(voltage, power), 6) AS c FROM {telemetry} GROUP BY zone",
    "agg_profile_assemble": "SELECT device_type, magnitude, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sigma, round(min(v), 3) AS least, round(max(v), 3) AS most FROM (SELECT device_type, 'voltage' AS magnitude, voltage AS v FROM {telemetry} UNION ALL SELECT device_type, 'current', current FROM {telemetry} UNION ALL SELECT device_type, 'power', power FROM {telemetry}) q GROUP BY device_type, magnitude",
    # --- window functions, sorts, reshape, set operations ---
    "win_interarrival": "SELECT zone, percentile_cont(0.5) WITHIN GROUP (ORDER BY gap) AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY gap) AS p95, percentile_cont(0.99) WITHIN GROUP (ORDER BY gap) AS p99, min(gap) AS least, max(gap) AS most FROM (SELECT zone, (ts_us - lag(ts_us) OVER (PARTITION BY device_id ORDER BY ts_us)) / 1e6 AS gap FROM {telemetry}) q WHERE gap IS NOT NULL GROUP BY zone",
    "win_latest_per_key": "SELECT device_id, id, ts_us FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts_us DESC, id DESC) AS r FROM {telemetry}) q WHERE r = 1",
    "win_episode_edges": "SELECT zone, bin, above AND NOT coalesce(before, FALSE) AS rise FROM (SELECT zone, bin, above, lag(above) OVER (PARTITION BY zone ORDER BY bin) AS before FROM (SELECT zone, bin, avg(value) > 50 AS above FROM {cells} GROUP BY zone, bin) p) q",
    "win_sign_crossings": "SELECT zone, bin FROM (SELECT zone, bin, up, lag(up) OVER (PARTITION BY zone ORDER BY bin) AS before FROM (SELECT zone, bin, avg(value) > 50 AS up FROM {cells} GROUP BY zone, bin) p) q WHERE up <> before",
    "win_log_gradient": "SELECT zone, bin, round(CASE WHEN b IS NULL THEN (n - y) / (xn - x) WHEN n IS NULL THEN (y - b) / (x - xb) ELSE (pow(x - xb, 2e0) * n + (pow(xn - x, 2e0) - pow(x - xb, 2e0)) * y - pow(xn - x, 2e0) * b) / ((x - xb) * (xn - x) * (xn - xb)) END, 6) AS gradient FROM (SELECT zone, bin, y, x, lag(y) OVER w AS b, lead(y) OVER w AS n, lag(x) OVER w AS xb, lead(x) OVER w AS xn FROM (SELECT zone, bin, ln(avg(value)) AS y, ln(row_number() OVER (PARTITION BY zone ORDER BY bin) + 0e0) AS x FROM {cells} GROUP BY zone, bin) p WINDOW w AS (PARTITION BY zone ORDER BY bin)) q",
    "win_local_extrema": "SELECT zone, bin, CASE WHEN y > b AND y > n THEN 'max' ELSE 'min' END AS kind FROM (SELECT zone, bin, y, lag(y) OVER (PARTITION BY zone ORDER BY bin) AS b, lead(y) OVER (PARTITION BY zone ORDER BY bin) AS n FROM (SELECT zone, bin, avg(value) AS y FROM {cells} GROUP BY zone, bin) p) q WHERE (y > b AND y > n) OR (y < b AND y < n)",
    "srt_recent_k": "SELECT id, device_id, arrival_us FROM {telemetry} ORDER BY arrival_us DESC, id DESC LIMIT 100",
    "srt_history_k": "SELECT id, arrival_us FROM {telemetry} WHERE device_id = 'dev-mon-00000007' ORDER BY arrival_us DESC, id DESC LIMIT 100",
    "srt_latest_one": "SELECT id, arrival_us FROM {telemetry} WHERE device_id = 'dev-mon-00000007' ORDER BY arrival_us DESC, id DESC LIMIT 1",
    "srt_table_20": "SELECT id, status FROM {telemetry} ORDER BY ts_us DESC, id DESC LIMIT 20",
    "srt_top2": "SELECT zone, device_id, value FROM (SELECT zone, device_id, value, row_number() OVER (PARTITION BY zone ORDER BY value DESC, id) AS r FROM {telemetry}) q WHERE r <= 2",
    "set_concat": "SELECT id, value FROM {telemetry} WHERE zone = 'z000001' UNION ALL SELECT id, value FROM {telemetry} WHERE zone = 'z000002'",
    "set_unknown_zones": "SELECT zone FROM (SELECT 'z000000' AS zone UNION ALL SELECT 'nowhere' UNION ALL SELECT 'z999999') w EXCEPT SELECT zone FROM {meters}",
    # --- scalar functions ---
    "sc_clamp": "SELECT id, greatest(210e0, least(230e0, voltage)) AS voltage FROM {telemetry}",
    "sc_relative_spread": "SELECT device_type, round(stddev_samp(voltage) / avg(voltage), 9) AS spread FROM {telemetry} GROUP BY device_type",
    "sc_zscore": "SELECT zone, idx, t, round(abs(value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w < 1e-12 THEN 1e0 ELSE stddev_pop(value) OVER w END, 6) AS z FROM {signal} WINDOW w AS (PARTITION BY zone, t)",
    "sc_mad_threshold": "SELECT s.zone, round(max(m) + 3 * percentile_cont(0.5) WITHIN GROUP (ORDER BY abs(s.value - m)), 6) AS cut FROM {signal} s JOIN (SELECT zone, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS m FROM {signal} GROUP BY zone) q ON s.zone = q.zone GROUP BY s.zone",
    "sp_zero_tol": "SELECT zone, count(*) * 2.220446049250313e-16 * greatest(2e0, 1e0) AS tolerance FROM {points} GROUP BY zone",
    # --- graph readings ---
    "jn_pairwise_self": "SELECT zone, src, dst, round(dist, 6) AS dist FROM {pairs} WHERE src < dst",
    "gr_degree": "SELECT zone, src AS idx, round(sum(weight), 6) AS degree FROM {edges} GROUP BY zone, src",
    "gr_khop_sizes": "SELECT zone, radius, centre, size FROM {balls}",
    "gr_components_check": "SELECT zone, count(DISTINCT src) AS touched FROM {edges} GROUP BY zone",
    # --- streaming rules, batch form ---
    "st_bin": "SELECT id, CAST(floor(ts_us / 6e6) AS BIGINT) AS bin, CAST(floor(ts_us / 6e6) AS BIGINT) * 6000000 AS start_us FROM {telemetry}",
    "st_last_closed": "SELECT id, CASE WHEN floor((arrival_us - 5000000) / 6e6) - 1 >= 0 THEN CAST(floor((arrival_us - 5000000) / 6e6) AS BIGINT) - 1 END AS last_closed FROM {telemetry}",
    "st_cycle_interval": "SELECT max(6e0 / k) AS interval FROM (SELECT 2 AS k UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 10 UNION ALL SELECT 20 UNION ALL SELECT 30 UNION ALL SELECT 60) q WHERE 6e0 / k <= 3e0 AND 6e0 / k >= 20 * 0.001394e0",
    # --- evaluation ---
}
