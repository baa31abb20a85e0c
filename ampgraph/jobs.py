"""Batch jobs: a specification in, files out."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidSpec, UnknownDevice
from .operators import graph, inject
from .operators.inject import EventSpec
from .shipping import ship
from .sources import sinks, tables


def read_spec(text: str) -> dict:
    """A specification: zones (or all), instants, seed, mean and sigma, bounds, and events by spread or fraction."""
    spec = {"zones": None, "instants": 64, "seed": 0, "mean": 220.0, "sigma": 1.5, "bounds": None, "on_violation": "raise", "events": []} | json.loads(text)
    if not spec["events"]:
        raise InvalidSpec("no events")
    for e in spec["events"]:
        EventSpec(zone="", seed_idx=0, start=e["start"], duration=e["duration"], depth=e.get("depth"), size_target=e.get("size_target"), shape=e.get("shape", "compact"), sigma_multiple=e.get("sigma_multiple"), fraction=e.get("fraction"), direction=e.get("direction", 1), on_violation=spec["on_violation"])
        if e["start"] + e["duration"] > spec["instants"]:
            raise InvalidSpec("an event ends after the signal")
    return spec


def injected(points: DataFrame, links: DataFrame, spec: dict) -> tuple[DataFrame, DataFrame]:
    """(signal rows, a row of truth for each event and zone): the specification's events on a null signal of every zone.

    Events apply in their order within the bounds, each on what earlier ones left. One without a seed gets one drawn from the zone's meters.
    """
    spark = points.sparkSession
    ship(spark)
    if spec["zones"]:
        points, links = (df.where(F.col("zone").isin(spec["zones"])) for df in (points, links))
    zones = points.select("zone").distinct()
    rows = [(i, e["start"], e["duration"], e.get("depth"), e.get("size_target"), e.get("shape", "compact"), e.get("seed_device_id"), e.get("sigma_multiple"), e.get("fraction"), e.get("direction", 1)) for i, e in enumerate(spec["events"])]
    events = spark.createDataFrame(rows, "event int, start int, duration int, depth int, size_target int, shape string, seed_device_id string, sigma_multiple double, fraction double, direction int")
    seeds = points.select("zone", F.col("idx").alias("seed_idx"), F.col("device_id").alias("seed_device_id"))
    named, open_ = events.where("seed_device_id is not null").join(seeds, "seed_device_id", "left"), events.where("seed_device_id is null").drop("seed_device_id")
    if bad := named.where("zone is null").take(1):
        raise UnknownDevice(bad[0]["seed_device_id"])
    spread = inject.seeds(points, open_.crossJoin(F.broadcast(zones)), spec["seed"]).join(seeds, ["zone", "seed_idx"])
    placed = named.unionByName(spread)
    groups = []
    for depth in sorted({e["depth"] for e in spec["events"] if e.get("depth") is not None}):
        reach = graph.k_hop(links, points, depth).withColumnRenamed("centre", "seed_idx")
        groups.append(placed.where(F.col("depth") == depth).select("zone", "event", "seed_idx").join(reach, ["zone", "seed_idx"]).select("zone", "event", "idx"))
    sized = placed.where("size_target is not null")
    if any(e.get("size_target") is not None for e in spec["events"]):
        wanted = sized.select("zone", F.col("event").cast("long").alias("event"), F.col("seed_idx").cast("long").alias("seed_idx"), F.col("size_target").alias("size"), "shape")
        groups.append(inject.subgraphs(links, wanted, spec["seed"]).select("zone", F.col("event").cast("int").alias("event"), "idx"))
    members = groups[0]
    for g in groups[1:]:
        members = members.unionByName(g)
    signal = inject.null_signal(points, spec["instants"], spec["mean"], spec["sigma"], spec["seed"])
    asked = inject.changes(members, placed, points.select("zone", "idx", F.lit(spec["sigma"]).alias("sigma")))
    low, high = spec["bounds"] or (None, None)
    rows, done = inject.apply_events(signal, asked, low, high, spec["on_violation"])
    return rows, inject.truth(done, members, placed, links, points)


def main(arguments: list[str] | None = None) -> None:
    """``python -m ampgraph.jobs SPEC.json TABLES OUT``: injects a specification's events into every zone and writes the files."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("spec")
    parser.add_argument("tables")
    parser.add_argument("out")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    spec = read_spec("\n".join(r.value for r in spark.read.text(given.spec, wholetext=True).collect()))
    points = graph.nodes(tables.load_meters(tables.meters(spark, given.tables)))
    rows, events = injected(points, graph.edges(points), spec)
    sinks.write_injection(rows, f"{given.out}/signal")
    sinks.write_injection_documents(rows, events, given.out)


if __name__ == "__main__":
    main()
