"""Relations that the registered queries read: as DataFrames of the library, and as DuckDB common table expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, graph, windows
from ..sources import tables

DAY_US = 86_400_000_000
#: Bins of three days leave some cells empty, bins of five days nearly none; windows are three bins long.
GAPPY, FULL, LENGTH, SIGMA, THRESHOLD = 3 * DAY_US, 5 * DAY_US, 3, 50.0, 2.0

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def view(f):
    SPARK[f.__name__] = f
    return f


_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(f):
    """A view whose rows stay in memory for the session: the graph of a network, which every cycle reads and none changes."""

    @functools.wraps(f)
    def once(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir, f.__name__)
        if key not in _kept:
            _kept[key] = f(spark, sf_dir).persist()
        return _kept[key]

    return once


def forget() -> None:
    """Release what is kept in memory: for new files under an old path, and for timings without it."""
    while _kept:
        _kept.popitem()[1].unpersist()


def get(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return SPARK[name](spark, sf_dir)


@view
def meters(s, d):
    return tables.meters(s, d)


@view
def telemetry(s, d):
    return tables.telemetry(s, d)


@view
@kept
def points(s, d):
    return graph.nodes(tables.meters(s, d))


@view
def pairs(s, d):
    return graph.pairs(points(s, d))


@view
@kept
def edges(s, d):
    return graph.edges(points(s, d))


@view
def cells(s, d):
    return windows.cells(tables.telemetry(s, d), GAPPY)


@view
def cells_full(s, d):
    return windows.cells(tables.telemetry(s, d), FULL)


@view
def means(s, d):
    return windows.dense_means(cells_full(s, d), points(s, d), LENGTH)


@view
@kept
def balls(s, d):
    return graph.balls(edges(s, d), points(s, d), (1, 2))


@view
def ball_members(s, d):
    return balls(s, d).select("zone", "radius", "centre", "size", "n", F.explode("members").alias("idx"))


@view
def scores(s, d):
    return detect.contrasts(means(s, d), balls(s, d), SIGMA, LENGTH)


@view
def signal(s, d):
    """(zone, t, idx, value): the cells of five-day bins as a signal over nodes."""
    return cells_full(s, d).join(points(s, d).select("zone", "device_id", "idx"), ["zone", "device_id"]).select("zone", F.col("bin").alias("t"), "idx", "value")


DUCK = {
    "meters": """
SELECT 'dev-' || CASE WHEN user_id % 3 = 0 THEN 'tri' ELSE 'mon' END || '-' || lpad(user_id::VARCHAR, 8, '0') AS device_id,
  CASE WHEN user_id % 3 = 0 THEN 'tri' ELSE 'mono' END AS device_type,
  'z' || lpad((user_id // 25)::VARCHAR, 6, '0') AS zone,
  5.03e0 + ((user_id * 7919) % 9000) / 1e5 AS lat, -75.55e0 + ((user_id * 104729) % 11000) / 1e5 AS lon,
  'n' || (user_id % 4)::VARCHAR AS node, min(epoch_us(ts)) AS installed_us, max(epoch_us(ts)) AS last_seen_us,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id % 7 <> 0 END AS active
FROM events GROUP BY user_id""",
    "telemetry": """
SELECT event_id AS id, 'dev-' || CASE WHEN user_id % 3 = 0 THEN 'tri' ELSE 'mon' END || '-' || lpad(user_id::VARCHAR, 8, '0') AS device_id,
  CASE WHEN user_id % 3 = 0 THEN 'tri' ELSE 'mono' END AS device_type, 'z' || lpad((user_id // 25)::VARCHAR, 6, '0') AS zone,
  epoch_us(ts) AS ts_us, epoch_us(ts) + ((event_id * 37) % 4000 - 600) * 1000 AS arrival_us,
  200e0 + (v % 4000) / 100e0 AS voltage, (v % 600) / 10e0 AS current, (v % 3000) / 100e0 AS power,
  CASE WHEN v % 17 <> 0 THEN v / 1000e0 END AS energy, 59e0 + (v % 200) / 100e0 AS frequency, 0.5e0 + (v % 50) / 100e0 AS power_factor,
  CASE WHEN v % 7 <> 6 THEN (['activo', 'mantenimiento', 'falla', 'activo', 'corte', 'activo'])[v % 7 + 1] END AS status,
  'n' || (user_id % 4)::VARCHAR AS node, value
FROM (SELECT *, round(value * 100)::BIGINT AS v FROM events)""",
    "frames": """
SELECT zone, avg(lat) AS lat0, avg(lon) AS lon0 FROM meters GROUP BY zone""",
    "radii": """
SELECT zone, lat0, lon0, 6378137e0 * (1 - e2) / pow(1 - e2 * s * s, 1.5e0) AS m, 6378137e0 / sqrt(1 - e2 * s * s) AS n
FROM (SELECT *, sin(radians(lat0)) AS s, (1 / 298.257223563e0) * (2 - 1 / 298.257223563e0) AS e2 FROM frames)""",
    "points": """
SELECT zone, row_number() OVER (PARTITION BY zone ORDER BY device_id) - 1 AS idx, device_id,
  n * cos(radians(lat0)) * radians(lon - lon0) AS x, m * radians(lat - lat0) AS y
FROM meters JOIN radii USING (zone)""",
    "pairs": """
SELECT a.zone, a.idx AS src, b.idx AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
FROM points a JOIN points b ON a.zone = b.zone AND a.idx <> b.idx""",
    "knn": """
SELECT zone, src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY zone, src ORDER BY round(dist, 9), dst) AS r FROM pairs) WHERE r <= 4""",
    "edges": """
SELECT zone, src, dst, min(dist) AS dist, 1e0 AS weight
FROM (SELECT zone, src, dst, dist FROM knn UNION ALL SELECT zone, dst, src, dist FROM knn) GROUP BY zone, src, dst""",
    "ball1": """
SELECT zone, idx AS centre, idx FROM points UNION SELECT zone, src, dst FROM edges""",
    "ball2": """
SELECT zone, centre, idx FROM ball1 UNION SELECT b.zone, b.centre, e.dst FROM ball1 b JOIN edges e ON b.zone = e.zone AND b.idx = e.src""",
    "ball_lists": """
SELECT zone, radius, centre, list(idx ORDER BY idx) AS members
FROM (SELECT zone, 1 AS radius, centre, idx FROM ball1 UNION ALL SELECT zone, 2, centre, idx FROM ball2) GROUP BY zone, radius, centre""",
    "balls": """
SELECT zone, radius, centre, len(members) AS size, n, members
FROM (SELECT *, row_number() OVER (PARTITION BY zone, members ORDER BY radius, centre) AS k FROM ball_lists)
JOIN (SELECT zone, count(*) AS n FROM points GROUP BY zone) USING (zone) WHERE k = 1 AND len(members) < n""",
    "ball_members": "SELECT zone, radius, centre, size, n, unnest(members) AS idx FROM balls",
    "cells": f"""
SELECT zone, device_id, bin, value, n FROM (
  SELECT *, count(*) OVER (PARTITION BY zone, device_id, bin) AS n, row_number() OVER (PARTITION BY zone, device_id, bin ORDER BY ts_us DESC, id) AS r
  FROM (SELECT *, ts_us // {GAPPY} AS bin FROM telemetry)) WHERE r = 1""",
    "cells_full": f"""
SELECT zone, device_id, bin, value, n FROM (
  SELECT *, count(*) OVER (PARTITION BY zone, device_id, bin) AS n, row_number() OVER (PARTITION BY zone, device_id, bin ORDER BY ts_us DESC, id) AS r
  FROM (SELECT *, ts_us // {FULL} AS bin FROM telemetry)) WHERE r = 1""",
    "signal": "SELECT c.zone, c.bin AS t, p.idx, c.value FROM cells_full c JOIN points p USING (zone, device_id)",
    "means": f"""
SELECT zone, bin, idx, mean FROM (
  SELECT *, count(*) OVER (PARTITION BY zone, bin) AS ready FROM (
    SELECT zone, t AS bin, idx, avg(value) OVER w AS mean, count(value) OVER w AS filled FROM signal
    WINDOW w AS (PARTITION BY zone, idx ORDER BY t RANGE BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW)) WHERE filled = {LENGTH})
JOIN (SELECT zone, count(*) AS n FROM points GROUP BY zone) USING (zone) WHERE ready = n""",
    "scores": f"""
SELECT zone, bin, radius, centre, size,
  abs(inside / size - (total - inside) / (n - size)) / ({SIGMA}e0 / sqrt({LENGTH}e0) * sqrt(1e0 / size + 1e0 / (n - size))) AS statistic
FROM (SELECT b.zone, m.bin, b.radius, b.centre, b.size, b.n, sum(m.mean) AS inside FROM means m JOIN ball_members b USING (zone, idx) GROUP BY ALL)
JOIN (SELECT zone, bin, sum(mean) AS total FROM means GROUP BY zone, bin) USING (zone, bin)""",
    "degrees": "SELECT zone, src AS idx, sum(weight) AS degree FROM edges GROUP BY zone, src",
}



def duck(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` with the expressions that it reads, directly or by others, in front."""
    known = DUCK | (extra or {})
    names = re.compile(r"\b(" + "|".join(sorted(known, key=len, reverse=True)) + r")\b")
    order: list[str] = []

    def need(text: str) -> None:
        for n in names.findall(text):
            if n not in order:
                need(known[n].replace(f" {n} ", "  "))
                if n not in order:
                    order.append(n)

    need(sql)
    if not order:
        return sql
    head, rest = ("WITH RECURSIVE ", ", " + sql.split("WITH RECURSIVE", 1)[1]) if "WITH RECURSIVE" in sql else ("WITH ", "\n" + sql)
    return head + ", ".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order) + rest
