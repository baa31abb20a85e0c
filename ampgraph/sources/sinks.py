"""Sinks: payload rows for topics, idempotent batch tables, calibration files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD_VERSION = 1


def dispatch(status: DataFrame, root: str) -> DataFrame:
    """A row per topic: a window goes to its own and to the detection topic, a missing one to another, nothing else anywhere."""
    z = F.col("zone")
    topics = F.when(F.col("status") == "ventana", F.array(F.concat(F.lit(f"{root}/ventana/"), z), F.concat(F.lit(f"{root}/deteccion/"), z)))
    topics = topics.when(F.col("status") == "sin_datos", F.array(F.concat(F.lit(f"{root}/sin-ventana/"), z)))
    return status.withColumn("topic", F.explode(topics))


def encode(rows: DataFrame, key: str) -> DataFrame:
    """(key, value): the other columns as one JSON object."""
    return rows.select(key, F.to_json(F.struct(*(c for c in rows.columns if c != key))).alias("value"))


def window_payload(means: DataFrame, scores: DataFrame, detections: DataFrame, provenance: DataFrame, emitted_us: Column, top_k: int | None = 5) -> DataFrame:
    """(zone, value): one versioned JSON body per window: means in node order, detection, strongest balls, provenance.

    ``scores`` is the detector's ranking (zone, bin, place, ...), cut to ``top_k`` places (None: all);
    ``provenance`` has a zone column and any further ones, which go into the body as they are.
    """
    body = means.groupBy("zone", "bin").agg(F.array_sort(F.collect_list(F.struct("idx", "mean"))).alias("nodes"))
    top = scores if top_k is None else scores.where(F.col("place") <= top_k)
    top = top.groupBy("zone", "bin").agg(F.array_sort(F.collect_list(F.struct("place", "radius", "centre", "size", "statistic"))).alias("ranking"))
    found = detections.select("zone", "bin", F.struct("detected", "statistic", "candidates", "radius", "centre", "size").alias("detection"))
    origin = provenance.select("zone", F.struct(*(c for c in provenance.columns if c != "zone")).alias("provenance"))
    rows = body.join(found, ["zone", "bin"]).join(top, ["zone", "bin"], "left").join(origin, "zone", "left")
    return encode(rows.select("zone", F.lit(PAYLOAD_VERSION).alias("version"), "bin", emitted_us.alias("emitted_us"), "nodes", "detection", "ranking", "provenance"), "zone")


def missing_payload(status: DataFrame, missing: DataFrame, threshold_source: str) -> DataFrame:
    """(zone, value): one versioned JSON body per window that could not be made: its reason and the meters that lack."""
    rows = status.where("status = 'sin_datos'").join(missing, ["zone", "bin"], "left")
    return encode(rows.select("zone", F.lit(PAYLOAD_VERSION).alias("version"), "bin", "reason", "incomplete", "missing", F.lit(threshold_source).alias("threshold_source")), "zone")


def collect_in_memory(stream: DataFrame, name: str):
    """A query that keeps a stream's rows in the session as the table ``name``: for tests."""
    return stream.writeStream.format("memory").queryName(name).outputMode("append").start()


def append_batch(path: str):
    """A foreachBatch function that writes each batch under its own id, so that a repeated one replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def save_calibration(zones: DataFrame, path: str, magnitude: str, format_tag: str) -> None:
    """One pretty JSON file with sorted keys; zones are few by nature, and counted first."""
    if zones.limit(100_001).count() > 100_000:
        raise ValueError("too many zones for one calibration file")
    body = {r["zone"]: r.asDict() for r in zones.collect()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"format": format_tag, "version": 1, "magnitude": magnitude, "zones": body}, f, indent=2, sort_keys=True, ensure_ascii=False)


def write_injection(rows: DataFrame, path: str) -> None:
    """Signals, their bases and truth, a folder per zone."""
    rows.repartition("zone").write.mode("overwrite").partitionBy("zone").parquet(path)


def write_injection_documents(rows: DataFrame, events: DataFrame, path: str) -> None:
    """JSON beside the signals: a truth document per event and zone, and a summary per zone.

    ``rows`` is (zone, t, idx, value, base, truth), ``events`` the truth of the injection; the summary has each zone's instants, nodes and
    share of changed cells.
    """
    summary = rows.groupBy("zone").agg(F.count_distinct("t").alias("instants"), F.count_distinct("idx").alias("nodes"), F.count_if("truth").alias("changed"), F.avg(F.col("truth").cast("double")).alias("share"))
    summary.write.mode("overwrite").json(f"{path}/summary")
    events.write.mode("overwrite").json(f"{path}/truth")
