"""Collective deviation: every ball against its complement, the strongest contrast against a threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DetectorError
from . import spectral
from .tasks import spread


@dataclass(frozen=True)
class DetectorConfig:
    window: int = 16
    step: int | None = None
    radii: tuple[int, ...] = (1, 2)
    fpr_target: float = 0.01
    samples: int = 2000

    def __post_init__(self):
        if self.window < 1 or (self.step is not None and self.step < 1):
            raise DetectorError("window and step are at least 1")
        if not self.radii or min(self.radii) < 0:
            raise DetectorError("at least one radius, none negative")
        if not 0 < self.fpr_target < 1 or self.samples < 100:
            raise DetectorError("the false-positive rate lies between 0 and 1, and samples are at least 100")


def contrasts(means: DataFrame, balls: DataFrame, sigma: float, window: int) -> DataFrame:
    """(zone, bin, radius, centre, size, statistic) for every window and ball.

    The complement's mean follows from the zone's total, so each member is joined once, and sums are partial
    before the shuffle. The statistic is in standard errors of the difference of means.
    """
    if not np.isfinite(sigma) or sigma <= 0:
        raise DetectorError(f"sigma is finite and positive, not {sigma}")
    total = means.groupBy("zone", "bin").agg(F.sum("mean").alias("total"))
    member = balls.select("zone", "radius", "centre", "size", "n", F.explode("members").alias("idx"))
    inside = means.join(member, ["zone", "idx"]).groupBy("zone", "bin", "radius", "centre", "size", "n").agg(F.sum("mean").alias("inside"))
    rows = inside.join(total, ["zone", "bin"])
    rest = F.col("n") - F.col("size")
    gap = F.abs(F.col("inside") / F.col("size") - (F.col("total") - F.col("inside")) / rest)
    error = F.lit(sigma / float(np.sqrt(window))) * F.sqrt(F.lit(1e0) / F.col("size") + F.lit(1e0) / rest)
    return rows.select("zone", "bin", "radius", "centre", "size", (gap / error).alias("statistic"))


def prepare(means: DataFrame, links: DataFrame, tau: float | None = None, project: bool = False) -> DataFrame:
    """(zone, bin, idx, mean): windows' means after diffusion and without their part in the kernel, each where it is asked for."""
    x = means.select("zone", F.col("bin").alias("t"), "idx", F.col("mean").alias("value"))
    if tau is not None:
        x = spectral.diffuse(links, x, tau)
    if project:
        x = spectral.project_kernel(x, links)
    return x.select("zone", F.col("t").alias("bin"), "idx", F.col("value").alias("mean"))


def ranking(scored: DataFrame) -> DataFrame:
    """``scored`` with its place in each window: strongest first, ties to the smaller radius, then centre."""
    order = Window.partitionBy("zone", "bin").orderBy(F.desc(F.round("statistic", 9)), "radius", "centre")
    return scored.withColumn("place", F.row_number().over(order).cast("long"))


def detect(scored: DataFrame, threshold: float) -> DataFrame:
    """One row per window: the winning ball, null where its statistic isn't above the threshold."""
    key = F.struct(F.round("statistic", 9).alias("s"), (-F.col("radius")).alias("r"), (-F.col("centre")).alias("c"))
    best = scored.groupBy("zone", "bin").agg(F.max(F.struct(key.alias("k"), "radius", "centre", "size", "statistic")).alias("b"), F.count(F.lit(1)).alias("candidates"))
    hit = F.col("b.statistic") > threshold
    return best.select(
        "zone", "bin", hit.alias("detected"), F.col("b.statistic").alias("statistic"), "candidates",
        F.when(hit, F.col("b.radius")).alias("radius"), F.when(hit, F.col("b.centre")).alias("centre"), F.when(hit, F.col("b.size")).alias("size"),
    )


def plans(balls: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(zone, balls, threshold, sigma, window): all that a zone's scan needs, one row a zone.

    ``thresholds`` is (zone, threshold, sigma, window); balls are bounded by a zone's meters times the radii.
    """
    sets = balls.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("radius", "centre", "size", "n", "members"))).alias("balls"))
    return sets.join(thresholds.select("zone", F.col("threshold").cast("double").alias("threshold"), F.col("sigma").cast("double").alias("sigma"), F.col("window").cast("int").alias("window")), "zone")


def mean_arrays(means: DataFrame) -> DataFrame:
    """(zone, bin, means): a window's means as one array over nodes 0, 1, ..."""
    rows = means.groupBy("zone", "bin").agg(F.array_sort(F.collect_list(F.struct("idx", "mean"))).alias("m"))
    return rows.select("zone", "bin", F.col("m.mean").alias("means"))


def scan(windows: DataFrame, zone_plans: DataFrame) -> DataFrame:
    """``windows`` (zone, means, ...) with detected, statistic, threshold, candidates, radius, centre and size.

    Each row meets its zone's plan and is scanned within itself, so a stream needs no state for it, and a batch no shuffle beyond
    the join by zone. Rows without means, or of zones without a plan, get nulls. Ties go to the smaller radius, then centre.
    """
    total = F.aggregate("means", F.lit(0.0), lambda acc, x: acc + x)

    def score(b):
        inside = F.aggregate(b["members"], F.lit(0.0), lambda acc, i: acc + F.get(F.col("means"), i.cast("int")))
        rest = (b["n"] - b["size"]).cast("double")
        error = F.col("sigma") / F.sqrt(F.col("window").cast("double")) * F.sqrt(1 / b["size"] + 1 / rest)
        value = F.abs(inside / b["size"] - (F.col("__total") - inside) / rest) / error
        return F.struct(F.round(value, 9).alias("s"), (-b["radius"]).alias("r"), (-b["centre"]).alias("c"), b["size"].alias("size"), value.alias("statistic"))

    rows = windows.join(zone_plans, "zone", "left").withColumn("__total", total)
    best = F.when(F.col("means").isNotNull(), F.array_max(F.transform("balls", score)))
    rows = rows.withColumn("__best", best).withColumn("detected", F.col("__best.statistic") > F.col("threshold"))
    hit = lambda c: F.when(F.col("detected"), c)
    return rows.withColumns({
        "statistic": F.col("__best.statistic"), "candidates": F.when(F.col("__best").isNotNull(), F.size("balls").cast("long")), "radius": hit(-F.col("__best.r")), "centre": hit(-F.col("__best.c")), "size": hit(F.col("__best.size")),
    }).drop("__best", "__total", "balls", "sigma", "window")


def node_mask(detections: DataFrame, balls: DataFrame, window: int) -> DataFrame:
    """(zone, t, idx): the cells that detections cover, each once."""
    hit = detections.where("detected").join(balls.select("zone", "radius", "centre", "members"), ["zone", "radius", "centre"])
    cells = hit.select("zone", F.explode(F.sequence(F.col("bin") - (window - 1), F.col("bin"))).alias("t"), "members")
    return cells.select("zone", "t", F.explode("members").alias("idx")).distinct()


def meter_threshold(means: DataFrame, mean: float, sigma: float, window: int) -> DataFrame:
    """(zone, bin, statistic): the largest single-meter deviation of each window, in standard errors."""
    return means.groupBy("zone", "bin").agg((F.max(F.abs(F.col("mean") - mean)) / F.lit(sigma / float(np.sqrt(window)))).alias("statistic"))


def _probes(masks: np.ndarray, sigma: float, window: int) -> np.ndarray:
    """(n, balls): weights whose product with a window's means is each ball's contrast in standard errors."""
    n, size = masks.shape[1], masks.sum(1, keepdims=True)
    return ((masks / size - (1 - masks) / (n - size)) / (sigma / np.sqrt(window) * np.sqrt(1 / size + 1 / (n - size)))).T


def null_means(n: int, sigma: float, config: DetectorConfig, seed: int, instants: int | None = None) -> list[np.ndarray]:
    """(signals, windows, n) of each 50 simulated signals without events, in the order of one generator's draws."""
    length = instants or config.window
    if length < config.window:
        raise DetectorError("the signal is shorter than the window")
    starts = np.arange(0, length - config.window + 1, config.step or config.window)
    rng, out = np.random.default_rng(seed), []
    for at in range(0, config.samples, 50):
        x = rng.normal(0.0, sigma, (min(50, config.samples - at), length, n))
        sums = np.concatenate([np.zeros((len(x), 1, n)), x.cumsum(1)], 1)
        out.append((sums[:, starts + config.window] - sums[:, starts]) / config.window)
    return out


def null_maxima(masks: np.ndarray, sigma: float, config: DetectorConfig, seed: int, instants: int | None = None, means: list[np.ndarray] | None = None) -> np.ndarray:
    """The largest contrast of each simulated signal without events; ``means`` are of ``null_means``, where they are at hand."""
    weights = _probes(masks, sigma, config.window)
    return np.concatenate([np.abs(m @ weights).max((1, 2)) for m in means or null_means(masks.shape[1], sigma, config, seed, instants)])


def _masks(balls: pd.DataFrame) -> np.ndarray:
    masks = np.zeros((len(balls), int(balls["n"].iloc[0])))
    for row, members in enumerate(balls.sort_values(["radius", "centre"])["members"]):
        masks[row, members] = 1
    return masks


def _latest(make):
    """``make`` by its argument, of which the last value is kept: a task's zones of one size share their signals."""
    kept = {}

    def get(n):
        if n not in kept:
            kept.clear()
            kept[n] = make(n)
        return kept[n]

    return get


def calibrate(balls: DataFrame, sigma: float, config: DetectorConfig = DetectorConfig(), seed: int = 0, instants: int | None = None) -> DataFrame:
    """(zone, threshold, candidates): each zone's cut by simulation, zones in parallel, one generator per zone.

    Per window without ``instants``, per signal of that many instants with them. Zones of one size have the same draws, which a task makes once.
    """
    means = _latest(lambda n: null_means(n, sigma, config, seed, instants))

    def zone(pdf: pd.DataFrame) -> pd.DataFrame:
        masks = _masks(pdf)
        top = null_maxima(masks, sigma, config, seed, instants, means(masks.shape[1]))
        return pd.DataFrame({"zone": [pdf["zone"].iloc[0]], "threshold": [float(np.quantile(top, 1 - config.fpr_target))], "candidates": [len(pdf)]})

    return spread(balls, "zone").groupBy("zone").applyInPandas(zone, "zone string, threshold double, candidates long")


def _long_means(n: int, sigma: float, config: DetectorConfig, seed: int, instants: int) -> list[np.ndarray]:
    """(windows, n) of a long signal without events, drawn in pieces of which each begins with the last window of the one before."""
    w, step = config.window, config.step or config.window
    rng, held, out, first = np.random.default_rng(seed), np.empty((0, n)), [], 0
    for at in range(0, instants, 4096):
        held = np.concatenate([held, rng.normal(0.0, sigma, (min(4096, instants - at), n))])
        starts = np.arange(first, len(held) - w + 1, step)
        sums = np.concatenate([np.zeros((1, n)), held.cumsum(0)])
        out.append((sums[starts + w] - sums[starts]) / w)
        if len(starts):
            keep = min(starts[-1] + step, len(held))
            first, held = starts[-1] + step - keep, held[keep:]
    return out


def validate(balls: DataFrame, thresholds: DataFrame, sigma: float, config: DetectorConfig = DetectorConfig(), seed: int = 1, instants: int = 60_000, bins_per_hour: int = 600) -> DataFrame:
    """A zone's false alarms of its threshold on a long signal without events: windows, fired, episodes, share, and by hour.

    By hour (of ``bins_per_hour`` instants, where a window begins) there are the mean, p95 and most of fired and of episodes.
    An episode is a run of windows that fire. Zones of one size have the same signal, which a task draws once.
    """

    rates = ", ".join(f"{name}_{kind} double" for name in ("fired", "episodes") for kind in ("mean", "p95", "most"))
    means = _latest(lambda n: _long_means(n, sigma, config, seed, instants))

    def zone(b: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(t):
            return pd.DataFrame()
        masks, step = _masks(b), config.step or config.window
        weights = _probes(masks, sigma, config.window)
        hit = np.concatenate([np.abs(m @ weights).max(1) > t["threshold"].iloc[0] for m in means(masks.shape[1])])
        rise = hit & ~np.r_[False, hit[:-1]]
        hour = np.arange(len(hit)) * step // bins_per_hour
        row = {"zone": b["zone"].iloc[0], "windows": len(hit), "fired": int(hit.sum()), "episodes": int(rise.sum()), "share": float(hit.mean()), "hours": int(hour[-1]) + 1}
        for name, x in (("fired", hit), ("episodes", rise)):
            by_hour = np.bincount(hour, x)
            row |= {f"{name}_mean": float(by_hour.mean()), f"{name}_p95": float(np.percentile(by_hour, 95)), f"{name}_most": float(by_hour.max())}
        return pd.DataFrame([row])

    cuts = spread(thresholds.select("zone", "threshold"), "zone").groupBy("zone")
    return spread(balls, "zone").groupBy("zone").cogroup(cuts).applyInPandas(zone, f"zone string, windows long, fired long, episodes long, share double, hours long, {rates}")


def check_frozen(frozen: DataFrame, live: DataFrame) -> DataFrame:
    """(zone, problem) of frozen thresholds that can't be adopted; no rows if all can.

    ``frozen`` has zone, threshold, sigma, window and fingerprint; ``live`` zone, sigma, window and fingerprint.
    """
    both = live.alias("l").join(frozen.alias("f"), F.col("l.zone") == F.col("f.zone"), "full")
    problem = (
        F.when(F.col("f.zone").isNull(), "missing")
        .when(F.col("l.zone").isNull(), "extra")
        .when(F.abs(F.col("f.sigma") - F.col("l.sigma")) > 1e-9 * F.abs(F.col("l.sigma")), "sigma")
        .when(F.col("f.window") != F.col("l.window"), "window")
        .when(F.col("f.fingerprint") != F.col("l.fingerprint"), "changed")
        .when(~(F.col("f.threshold") > 0) | F.isnan("f.threshold") | (F.col("f.threshold") == float("inf")), "threshold")
    )
    return both.select(F.coalesce("l.zone", "f.zone").alias("zone"), problem.alias("problem")).where("problem is not null")
