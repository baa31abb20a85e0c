"""Detection experiments: simulated trials for every zone and parameter set, as one grouped job.

A parameter set is a row (sigma, window, length, depth, size, shape, radii, tau, aligned). A zone tries all sets of a
grid, so that sets share draws and balls; zones spread over the cluster. Rates compare the ball scan with the largest
single-meter deviation on the same clean and event signals; STATISTICS are also scored each for itself.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spectral
from ..errors import InvalidSpec
from .inject import walk, zone_key
from .tasks import spread

CALIBRATION, FPR, MEAN, SIGMA = 600, 0.01, 220.0, 1.5
FIELDS = "sigma double, window int, length int, depth int, size int, shape string, radii array<int>, tau double, aligned boolean, trials int"
BASE = {"sigma": 0.5, "window": 16, "length": 16, "depth": 2, "size": 0, "shape": "compact", "radii": [1, 2], "tau": 0.0, "aligned": True, "trials": 300}
#: The grids that published figures are for.
WINDOWS, SIGMAS, RADII = (1, 2, 4, 8, 16, 32, 64), (0.5, 1.0, 1.5), ([1], [1, 2], [1, 2, 3])
TAUS = (0.05, 0.1, 0.25, 0.447, 0.75, 1.0, 1.5, 2.239, 3.0, 5.0, 10.0, 20.0)
MAGNITUDES, DURATIONS = (0.5, 1.0, 1.5, 2.0, 3.0), (1, 2, 5, 10, 20, 50)
SIZES, CONTRAST_SIZES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24), (5, 6, 8)
DEPTHS, INDIVIDUAL, COLLECTIVE = (0, 1, 2, 3), 6.0, 1.0
SLIDING_WINDOWS, SLIDING_RADII, LONG = (4, 8, 16, 32), ([1], [1, 2]), 4
#: What a window's mean signal is scored by: the largest single deviation, the ball scan, Dirichlet energies of the
#: normalised (of the signal, and of the signal less its mean) and the combinatorial Laplacian, the largest deviation
#: from a node's neighbours, and the contrast of the true group, which no method can know.
#: Windows a seed below which all seeds' windows are one array.
NARROW = 100
STATISTICS = ("threshold", "scan", "dirichlet", "dirichlet_centred", "dirichlet_combinatorial", "local_residual", "oracle")


def grid(spark, **axes) -> DataFrame:
    """All combinations of the named values over the defaults."""
    rows = [{**BASE, **dict(zip(axes, v, strict=True))} for v in itertools.product(*axes.values())]
    for r in rows:
        r["length"] = max(r["length"], r["window"])
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FIELDS)


def hops(a: np.ndarray, depth: int) -> np.ndarray:
    """Boolean (n, n): who is within ``depth`` hops of whom."""
    reach = np.eye(len(a), dtype=bool)
    for _ in range(depth):
        reach = reach | (reach.astype(float) @ (a > 0) > 0)
    return reach


def ball_masks(a: np.ndarray, radii) -> np.ndarray:
    rows = {}
    for r in sorted(set(radii)):
        for mask in hops(a, r):
            if not mask.all():
                rows.setdefault(mask.tobytes(), mask)
    return np.array(list(rows.values()), float).reshape(len(rows), len(a))


def window_means(x: np.ndarray, window: int) -> np.ndarray:
    """(trials, windows, n): means of all sliding windows of signals (trials, T, n)."""
    if window == x.shape[1]:
        return x.sum(1, keepdims=True) / window
    sums = np.concatenate([np.zeros((len(x), 1, x.shape[2])), x.cumsum(1)], 1)
    return (sums[:, window:] - sums[:, :-window]) / window


def probes(masks: np.ndarray, window: int, sigma: float) -> np.ndarray:
    """(balls, n): weights whose product with a window's means is each ball's contrast in standard errors."""
    n, k = masks.shape[1], masks.sum(1, keepdims=True)
    return (masks / k - (1 - masks) / (n - k)) / (sigma / np.sqrt(window) * np.sqrt(1 / k + 1 / (n - k)))


def responses(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """(probes, trials, windows): products of windows' means (trials, windows, n) with each probe."""
    return (weights @ means.reshape(-1, means.shape[2]).T).reshape(len(weights), *means.shape[:2])


def loudest(found: np.ndarray) -> np.ndarray:
    """The largest magnitude along the first axis, without a copy of all magnitudes."""
    return np.maximum(found.max(0), -found.min(0))


def strongest(clean: np.ndarray, shift: np.ndarray, seeds: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The largest response of any probe in each window (one of a trial's, ``seeds`` ascending) once events are on top.

    Responses are linear in the signal, so an event's part is ``shift`` (probes, seeds) times the ``share`` of the window that it fills.
    """
    if len(share) < NARROW * shift.shape[1]:
        return loudest(shift.take(seeds, axis=1) * share + clean)
    best = np.empty(len(share))
    first = np.r_[0, np.flatnonzero(np.diff(seeds)) + 1, len(seeds)]
    for low, high in itertools.pairwise(first.tolist()):
        y = np.multiply.outer(shift[:, seeds[low]], share[low:high])
        y += clean[:, low:high]
        best[low:high] = np.abs(y, out=y).max(0)
    return best


def separation(down: np.ndarray, up: np.ndarray) -> tuple[float, float]:
    """(rate of ``up`` above the clean quantile, Mann-Whitney AUC by ordinal ranks)."""
    return float((up > np.quantile(down, 1 - FPR)).mean()), auc(down, up)


def auc(down: np.ndarray, up: np.ndarray) -> float:
    """Mann-Whitney AUC by ordinal ranks, in which clean values come before equal ones."""
    return float(np.sort(down).searchsorted(up, side="right").sum() / (len(down) * len(up)))


def statistics(x: np.ndarray, a: np.ndarray, masks: np.ndarray, own: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """STATISTICS of signals (trials, T, n), the largest over all windows; ``own`` (trials, n) marks each true group."""
    mean = window_means(x, window)
    found = _statistics(mean.reshape(-1, mean.shape[2]), a, masks, window)
    found["oracle"] = _contrast(mean.reshape(-1, mean.shape[2]), own.repeat(mean.shape[1], axis=0))
    return {name: found[name].reshape(mean.shape[:2]).max(1) for name in STATISTICS}


def _statistics(mean: np.ndarray, a: np.ndarray, masks: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """STATISTICS but the oracle's of each window's means (windows, n)."""
    plain, norm = np.diag(a.sum(1)) - a, spectral.normalised(a)
    energy = lambda y, m: np.einsum("wi,ij,wj->w", y, m, y, optimize=True)
    around = a / np.maximum(a.sum(1), 1e-300)[:, None]
    return {
        "threshold": np.abs(mean).max(1),
        "scan": loudest(probes(masks, window, SIGMA) @ mean.T),
        "dirichlet": energy(mean, norm),
        "dirichlet_centred": energy(mean - mean.mean(1, keepdims=True), norm),
        "dirichlet_combinatorial": energy(mean, plain),
        "local_residual": np.abs(mean - mean @ around.T).max(1),
    }


def _contrast(mean: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The contrast of each window's true group (windows, n)."""
    k, inside = own.sum(1), np.einsum("wi,wi->w", mean, own.astype(float))
    return np.abs(inside / k - (mean.sum(1) - inside) / np.maximum(mean.shape[1] - k, 1))


def grown(neighbours: dict[int, list[int]], seed: int, size: int, shape: str, rng: np.random.Generator) -> list[int]:
    """A group by a walk, or of the nodes nearest to the seed; of the last layer the least draws."""
    if shape == "extended":
        return walk(neighbours, seed, size, rng)
    layer = {seed: 0}
    for node in (queue := [seed]):
        for other in neighbours.get(node, ()):
            if other not in layer:
                layer[other] = layer[node] + 1
                queue.append(other)
    if len(layer) < size:
        raise InvalidSpec(f"only {len(layer)} of {size} nodes can be reached")
    draw = dict(zip(sorted(layer), rng.random(len(layer)), strict=True))
    return sorted(sorted(layer, key=lambda i: (layer[i], draw[i]))[:size])


def draw(seed: int, n: int, p) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window means of the calibration's and of the clean signals, and where events begin if not at 0; trials by seed."""
    window, length = int(p.window), int(p.length)
    rng = np.random.default_rng([seed, window, int(p.sigma * 100), length])
    null = window_means(rng.normal(0, SIGMA, (CALIBRATION, length, n)), window)
    clean = window_means(rng.normal(MEAN, SIGMA, (int(p.trials), length, n)) - MEAN, window)
    starts = rng.integers(0, length - window + 1, int(p.trials))
    order = (np.arange(int(p.trials)) % n).argsort(kind="stable")
    return null, clean[order], starts[order]


class Trials:
    """All parameter sets of one zone. What sets share is made once: balls, groups, and clean signals' responses.

    ``draws`` are the signals by (window, sigma, length, trials) and what single meters show of them, which zones of one
    seed and size share too.
    """

    def __init__(self, a: np.ndarray, seed: int, draws: dict, scores: bool = True):
        self.a, self.n, self.seed, self.draws, self.scores, self.made = a, len(a), seed, draws, scores, {}
        self.around = {i: np.flatnonzero(a[i] > 0).tolist() for i in range(self.n)}

    def once(self, key, make, kept: dict | None = None):
        kept = self.made if kept is None else kept
        if key not in kept:
            kept[key] = make()
        return kept[key]

    def groups(self, p) -> np.ndarray:
        """(seeds, n): the group around each node; the node alone where a group of that size can't grow."""
        if not p.size:
            return hops(self.a, int(p.depth))
        out = np.zeros((self.n, self.n), bool)
        for i in range(self.n):
            try:
                out[i, grown(self.around, i, int(p.size), p.shape, np.random.default_rng([self.seed, i]))] = True
            except ValueError:
                out[i, i] = True
        return out

    def smooth(self, tau: float) -> np.ndarray:
        values, u = self.once("eigh", lambda: spectral.eigh(spectral.normalised(self.a)))
        return (u * spectral.low_pass(values, tau)) @ u.T

    def touched(self, p):
        """(trial, share, place, where each trial begins) of the windows that events reach, by trial."""
        window, (_, means, starts) = int(p.window), self.drawn(p)
        begin = np.zeros_like(starts) if p.aligned else starts
        share = np.maximum(window - np.abs(np.arange(means.shape[1]) - begin[:, None]), 0).ravel() / window
        place = np.flatnonzero(share)
        at = place // means.shape[1]
        return at, share[place], place, np.flatnonzero(np.r_[True, at[1:] != at[:-1]])

    def clean(self, p, weights: np.ndarray, place: np.ndarray):
        """(responses in touched windows, each trial's largest in the others, and in all)."""
        found = responses(weights, self.drawn(p)[1])
        most = loudest(found)
        others = most.copy()
        others.reshape(-1)[place] = 0
        found = found.reshape(len(weights), -1)
        return found if len(place) == found.shape[1] else found.take(place, axis=1), others.max(1), most.max(1)

    def meters(self, p, share: np.ndarray, place: np.ndarray, first: np.ndarray):
        """(each trial's largest deviation in windows out of an event's reach, its quantile in all, and by meter the largest in reach without and with the event)."""
        means = np.abs(self.drawn(p)[1])
        most = means.max(2)
        still = np.quantile(most.max(1), 1 - FPR)
        most.reshape(-1)[place] = 0
        quiet = np.maximum.reduceat(means.reshape(-1, self.n)[place], first)
        reached = self.drawn(p)[1].reshape(-1, self.n)[place]
        reached += (p.sigma * SIGMA * share)[:, None]
        return most.max(1), still, quiet, np.maximum.reduceat(np.abs(reached, out=reached), first)

    def clean_statistics(self, p, masks: np.ndarray) -> dict[str, np.ndarray]:
        """STATISTICS but the oracle's of the clean signals (trials, windows)."""
        means = self.drawn(p)[1]
        return {name: x.reshape(means.shape[:2]) for name, x in _statistics(means.reshape(-1, self.n), self.a, masks, int(p.window)).items()}

    def scored(self, p, masks: np.ndarray, groups: np.ndarray, seeds: np.ndarray, at: np.ndarray, share: np.ndarray, place: np.ndarray) -> list[dict]:
        """Rate and AUC of each of STATISTICS; windows out of an event's reach are the clean ones."""
        window, means = int(p.window), self.drawn(p)[1].reshape(-1, self.n)
        down = self.once(("statistics", window, int(p.sigma * 100), int(p.length), int(p.trials), tuple(p.radii)), lambda: self.clean_statistics(p, masks))
        down = down | {"oracle": _contrast(means, groups[seeds.repeat(len(means) // len(seeds))]).reshape(len(seeds), -1)}
        reached = means[place] + (p.sigma * SIGMA * share)[:, None] * groups[seeds[at]]
        event = _statistics(reached, self.a, masks, window) | {"oracle": _contrast(reached, groups[seeds[at]])}
        out = []
        for name in STATISTICS:
            up = down[name].copy()
            up.reshape(-1)[place] = event[name]
            rate, area = separation(down[name].max(1), up.max(1))
            out.append({"statistic": name, "rate": rate, "auc": area})
        return out

    def weights(self, p, masks: np.ndarray):
        """(probes, cut): the balls' probes after diffusion, if any, and the calibration's quantile."""
        weights = probes(masks, int(p.window), SIGMA)
        if p.tau:
            weights = weights @ self.smooth(p.tau).T
        return weights, np.quantile(loudest(responses(weights, self.drawn(p)[0])).max(1), 1 - FPR)

    def drawn(self, p):
        key = int(p.window), int(p.sigma * 100), int(p.length), int(p.trials)
        if key not in self.draws:
            self.draws[key] = draw(self.seed, self.n, p)
        return self.draws[key]

    def run(self, p) -> dict:
        """Rates, false-positive rates, node confusion and scores by statistic of one parameter set."""
        n, window, trials = self.n, int(p.window), int(p.trials)
        masks = self.once(("masks", tuple(p.radii)), lambda: ball_masks(self.a, p.radii))
        out = dict.fromkeys(("scan_rate", "meter_rate", "advantage", "scan_fpr", "recall", "precision", "f1", "auc"), 0.0) | {"candidates": len(masks), "scores": []}
        if not len(masks):
            return out
        signals = window, int(p.sigma * 100), int(p.length), trials
        scanned, laid = (*signals, tuple(p.radii), p.tau), (*signals, p.aligned)
        weights, cut = self.once(("weights", *scanned), lambda: self.weights(p, masks))
        at, share, place, first = self.once(("touched", *laid), lambda: self.touched(p), self.draws)
        found, rest, miss = self.once(("balls", *scanned, p.aligned), lambda: self.clean(p, weights, place))
        far, still, quiet, reached = self.once(("meters", *laid), lambda: self.meters(p, share, place, first), self.draws)
        groups = self.once(("groups", p.size, p.shape if p.size else p.depth), lambda: self.groups(p))
        seeds, height = np.sort(np.arange(trials) % n), p.sigma * SIGMA
        shift = height * (weights @ groups.T)
        hit = strongest(found, shift, seeds[at], share)
        over = np.flatnonzero(hit > cut)
        detected = np.unique(at[over])
        tp = fp = fn = 0
        if len(over):
            winner = np.abs(found.take(over, axis=1) + shift[:, seeds[at[over]]] * share[over]).argmax(0)
            marked = np.logical_or.reduceat(masks[winner] > 0, np.searchsorted(at[over], detected))
            truth = groups[seeds[detected]]
            tp, fp, fn = (marked & truth).sum(), (marked & ~truth).sum(), (~marked & truth).sum()
        if self.scores:
            out["scores"] = self.scored(p, masks, groups, seeds, at, share, place)
        loud = np.maximum(far, np.where(groups[seeds], reached, quiet).max(1))
        hit = np.maximum(rest, np.maximum.reduceat(hit, first))
        out["scan_rate"], out["meter_rate"] = len(detected) / trials, (loud > still).mean()
        out["advantage"], out["scan_fpr"] = out["scan_rate"] - out["meter_rate"], (miss > cut).mean()
        out["recall"], out["precision"], out["f1"] = tp / max(tp + fn, 1), tp / max(tp + fp, 1), 2 * tp / max(2 * tp + fp + fn, 1)
        out["auc"] = auc(miss, hit)
        return out


def run(edges: DataFrame, sets: DataFrame, seed: int = 20260101, scores: bool = False) -> DataFrame:
    """One row per zone and parameter set; ``scores`` by statistic stay empty unless they are asked for.

    A zone is sent once and tries all sets, which are fixed by the caller. Zones lie by their part of the seed.
    """
    grid_rows = sets.collect()
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf("long")
    def part(zones: pd.Series) -> pd.Series:
        return zones.map(lambda z: zone_key(z) % 1000)

    lists = edges.groupBy("zone").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "weight"))).alias("links"))
    jobs = lists.select("zone", part("zone").alias("part"), F.col("links.src").alias("src"), F.col("links.dst").alias("dst"), F.col("links.weight").alias("weight"))

    def job(it):
        last, draws = None, {}
        for pdf in it:
            for z in pdf.itertuples():
                n = int(max(z.src.max(), z.dst.max())) + 1
                if (z.part, n) != last:
                    last, draws = (z.part, n), {}
                trials = Trials(spectral.matrix({"src": z.src, "dst": z.dst, "weight": z.weight}, n), seed + z.part, draws, scores)
                yield pd.DataFrame([{"zone": z.zone, **p.asDict(), **trials.run(p)} for p in grid_rows])

    out = "candidates long, scan_rate double, meter_rate double, advantage double, scan_fpr double, recall double, precision double, f1 double, auc double, scores array<struct<statistic:string,rate:double,auc:double>>"
    return spread(jobs, "part").sortWithinPartitions("part", F.size("src"), "zone").mapInPandas(job, f"zone string, {FIELDS}, {out}")


def by_statistic(rows: DataFrame) -> DataFrame:
    """(zone, sigma, window, depth, statistic, rate, auc)."""
    return rows.select("zone", "sigma", "window", "depth", F.inline("scores"))


def _mean(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("scan_rate", "meter_rate", "advantage", "scan_fpr", "recall", "precision", "f1", "auc")))


def event_signal(points: DataFrame, edges: DataFrame, depth: int, multiple: float) -> DataFrame:
    """(zone, t, idx, value): for each node as a seed, numbered t, the deviation of its neighbourhood alone."""
    from .graph import k_hop

    reach = k_hop(edges, points, depth).withColumn("hit", F.lit(multiple * SIGMA))
    every = points.select("zone", "idx").join(points.select("zone", F.col("idx").alias("centre")), "zone")
    return every.join(reach, ["zone", "centre", "idx"], "left").select("zone", F.col("centre").alias("t"), "idx", F.coalesce("hit", F.lit(0.0)).alias("value"))


def el_signature(points, edges, balls):
    """Spectral profile of the event at every seed, by depth."""
    out = None
    for depth in DEPTHS:
        rows = spectral.band_energy(edges, event_signal(points, edges, depth, 1.0)).select("zone", F.lit(depth).alias("depth"), F.col("t").alias("seed"), "mode_zero", "high_without_mean", "rayleigh")
        out = rows if out is None else out.union(rows)
    return out


def el_shape_vs_magnitude(points, edges, balls):
    """The same footprint at several magnitudes: the norm grows, the profile stays."""
    out = None
    for m in (0.5, 1.0, 2.0, 3.0):
        rows = spectral.band_energy(edges, event_signal(points, edges, 1, m)).groupBy("zone").agg(F.avg("total").alias("norm"), F.avg("high_without_mean").alias("high"), F.avg("rayleigh").alias("rayleigh")).withColumn("multiple", F.lit(m))
        out = rows if out is None else out.unionByName(rows)
    return out


def _grid(edges, scores=False, /, **axes):
    return run(edges, grid(edges.sparkSession, **axes), scores=scores)


def el_detection_table(points, edges, balls):
    """Every statistic on single meters and on collective events of each depth, one instant at a time."""
    spark = edges.sparkSession
    sets = grid(spark, sigma=[INDIVIDUAL], depth=[0], window=[1], trials=[500]).union(grid(spark, sigma=[COLLECTIVE], depth=list(DEPTHS[1:]), window=[1], trials=[500]))
    return by_statistic(run(edges, sets, scores=True))


def el_mag_dur(points, edges, balls):
    return _mean(_grid(edges, sigma=list(MAGNITUDES), window=list(DURATIONS), radii=[[1]], trials=[400]), "sigma", "window")


def el_mag_dur_cell(points, edges, balls):
    rows = by_statistic(_grid(edges, True, sigma=[COLLECTIVE], window=[10], radii=[[1]], trials=[400]))
    return rows.where(F.col("statistic").isin("threshold", "scan", "dirichlet_centred", "local_residual", "oracle"))


def el_advantage(points, edges, balls):
    return _grid(edges, sigma=list(SIGMAS), window=list(WINDOWS)).select("zone", "sigma", "window", "scan_rate", "meter_rate", "advantage")


def el_rates(points, edges, balls):
    return _grid(edges, sigma=[0.5]).select("zone", "scan_rate", "meter_rate")


def el_sliding_eval(points, edges, balls):
    """Events anywhere in signals four windows long."""
    parts = [grid(edges.sparkSession, window=[w], length=[LONG * w], radii=list(SLIDING_RADII), aligned=[False], trials=[200]) for w in SLIDING_WINDOWS]
    sets = parts[0]
    for p in parts[1:]:
        sets = sets.union(p)
    return run(edges, sets).drop("scores")


def el_sliding_known(points, edges, balls):
    return _mean(_grid(edges, length=[48], aligned=[True, False]), "aligned")


def el_radii(points, edges, balls):
    return _mean(_grid(edges, radii=list(RADII)), "radii")


def el_tau(points, edges, balls):
    """Without a filter (0), and with one of each strength."""
    return _mean(_grid(edges, tau=[0.0, *TAUS]), "tau")


def el_individual(points, edges, balls):
    return _mean(_grid(edges, depth=[0], sigma=[INDIVIDUAL], window=[1]), "sigma")


def el_group_size(points, edges, balls):
    """Sizes of compact groups, some also of walks; scan_fpr is the control of the calibration on the clean signals."""
    spark = edges.sparkSession
    sets = grid(spark, size=list(SIZES), shape=["compact"], length=[LONG * 16], aligned=[False], trials=[2000]).union(grid(spark, size=list(CONTRAST_SIZES), shape=["extended"], length=[LONG * 16], aligned=[False], trials=[2000]))
    return _mean(run(edges, sets), "size", "shape")
