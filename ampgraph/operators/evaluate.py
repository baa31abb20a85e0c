"""Evaluation: confusion, rank statistics, rates at a false-positive target, false-alarm episodes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of boolean ``predicted`` against ``truth``; a rate with nothing below it is 0."""
    p, t = F.col("predicted"), F.col("truth")
    counts = rows.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"recall": _ratio(tp, tp + fn), "precision": _ratio(tp, tp + fp), "fpr": _ratio(fp, fp + tn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def auc(scores: DataFrame, *by: str) -> DataFrame:
    """Mann-Whitney AUC with ordinal ranks (ties in the order of ids); ``scores`` has label, score, id.

    One numbering over all groups, in ranges; a group's ranks are its numbers less those before it.
    """
    ranked = numbered(scores.select(*by, "label", "score", "id"), *by, "score", "id", name="r")
    sums = ranked.groupBy(*by).agg(F.sum(F.when(F.col("label"), F.col("r"))).alias("s"), F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("q"), (F.min("r") - 1).alias("before"))
    rank_sum = F.col("s") - F.col("p") * F.col("before")
    return sums.withColumn("auc", F.try_divide(rank_sum - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))).drop("s", "before")


def rate_at_fpr(scores: DataFrame, fpr: float = 0.01) -> DataFrame:
    """The share of positives above the (1 - fpr) quantile of negatives."""
    cut = percentiles(scores.where(~F.col("label")), "score", {"cut": 1 - fpr}).first()[0]
    return scores.where("label").agg(F.avg((F.col("score") > F.lit(cut)).cast("double")).alias("rate")).withColumn("cut", F.lit(cut))


def numbered(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """``rows`` numbered from 1 in an order over all of them: sorted by ranges, with the ranges' counts as offsets.

    No task sees more than one range; only a count per range reaches the driver. ``order`` tells rows apart.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    placed = materialize(placed, "numbered")
    before, offsets = 0, {}
    for r in sorted(placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).collect()):
        offsets[r["__part"]] = before - r["first"]
        before += r["n"]
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__part", "__at")
    shift = F.element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.col("__part"))
    return placed.withColumn(name, F.col("__at") + shift + 1).drop("__part", "__at")


def spearman(rows: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Correlation of ordinal ranks, without averaging ties (which go by the key)."""
    a = numbered(rows.select(F.col(key).alias("__key"), F.col(x).alias("__x")), "__x", "__key", name="__a")
    b = numbered(rows.select(F.col(key).alias("__key"), F.col(y).alias("__y")), "__y", "__key", name="__b")
    return a.join(b.select("__key", "__b"), "__key").agg(F.corr("__a", "__b").alias("spearman"))


#: Of a group's ranks, the share within which a sketch places a value.
SKETCH = 10_000


def percentiles(rows: DataFrame, value: str, points: dict[str, float], *by: str) -> DataFrame:
    """Exact interpolated percentiles of all groups at once, a column each. Nulls don't count; groups without values have no row.

    A sketch of each group (small, and merged before the shuffle) brackets every wanted rank between two values that are certain to
    enclose it. A second pass counts the values below each bracket, and counts by value those inside: a few of
    ``SKETCH`` parts of a group (all of a group of less than twice ``SKETCH`` values). Only these meet in a window.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    names, keys = list(points), list(by)
    shares = sorted({min(max(q + e, 0.0), 1.0) for q in points.values() for e in (-4 / SKETCH, 4 / SKETCH)})
    at = {x: i for i, x in enumerate(shares)}
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.percentile_approx("__v", [float(x) for x in shares], SKETCH).alias("__s"))
    edge = lambda q, e: min(max(q + e, 0.0), 1.0)
    small = F.col("__n") < 2 * SKETCH  # a rank there is no share that a sketch tells apart
    low = lambda q: F.when(small | F.lit(edge(q, -4 / SKETCH) == 0), F.col("__least")).otherwise(F.col("__s")[at[edge(q, -4 / SKETCH)]])
    high = lambda q: F.when(small | F.lit(edge(q, 4 / SKETCH) == 1), F.col("__most")).otherwise(F.col("__s")[at[edge(q, 4 / SKETCH)]])
    brackets = sketch.select(*by, "__n", F.array(*(F.struct(low(q).alias("lo"), high(q).alias("hi")) for q in points.values())).alias("__b"))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        if not keys:
            return a.crossJoin(F.broadcast(b))
        b = b.withColumnsRenamed({c: f"__key_{c}" for c in keys})
        on = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in keys))
        return a.join(b, on).drop(*(f"__key_{c}" for c in keys))

    both = joined(rows, brackets)
    below = both.groupBy(*by).agg(F.first("__n").alias("__n"), *(F.count_if(F.col("__v") < F.col("__b")[i]["lo"]).alias(f"__below{i}") for i in range(len(names))))
    hit = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.col("__b")[i]["lo"].alias("lo"), F.col("__b")[i]["hi"].alias("hi")) for i in range(len(names)))), lambda x: (F.col("__v") >= x["lo"]) & (F.col("__v") <= x["hi"]))
    inside = both.select(*by, "__v", F.explode(hit).alias("h")).groupBy(*by, F.col("h.i").alias("__i"), "__v").agg(F.count(F.lit(1)).alias("__c"))
    run = inside.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*by, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    ranked, out = joined(run, below), []
    for i, (name, q) in enumerate(points.items()):
        h = F.lit(float(q)) * (F.col("__n") - 1)
        upto, own = F.col("__upto") + F.col(f"__below{i}"), F.col("__i") == i
        first, second = (F.min(F.when(own & (upto > f(h)), F.col("__v"))) for f in (F.floor, F.ceil))
        out.append((first + F.max(h - F.floor(h)) * (second - first)).alias(name))
    return ranked.groupBy(*by).agg(*out)


def episodes(flags: DataFrame, *by: str) -> DataFrame:
    """Windows that fired, and runs of them, per key; ``flags`` has t and fired."""
    before = F.lag("fired").over(Window.partitionBy(*by).orderBy("t"))
    rise = F.col("fired") & ~F.coalesce(before, F.lit(False))
    return flags.withColumn("rise", rise).groupBy(*by).agg(F.count(F.lit(1)).alias("windows"), F.count_if("fired").alias("fired"), F.count_if("rise").alias("episodes"))


def overlaps(detections: DataFrame, events: DataFrame) -> DataFrame:
    """Detections [start, stop) joined to the events [start, stop) of their zone that they overlap."""
    d, e = detections.alias("d"), events.alias("e")
    on = (F.col("d.zone") == F.col("e.zone")) & (F.col("d.start") < F.col("e.stop")) & (F.col("d.stop") > F.col("e.start"))
    return d.join(e, on).select(F.col("d.zone").alias("zone"), F.col("d.start").alias("start"), F.col("d.stop").alias("stop"), "e.event")


def reachable_contrast(groups: DataFrame, balls: DataFrame) -> DataFrame:
    """(zone, seed, reach): what the best ball can extract of a shift on a group, in shifts over the effective spread.

    ``groups`` is (zone, seed, idx). Of each ball, the group's share inside less its share outside, over the standard error
    of the two means; the largest counts.
    """
    k = groups.groupBy("zone", "seed").agg(F.count(F.lit(1)).alias("k"))
    member = balls.select("zone", "radius", "centre", F.explode("members").alias("idx"))
    hits = groups.join(member, ["zone", "idx"]).groupBy("zone", "seed", "radius", "centre").agg(F.count(F.lit(1)).alias("hit"))
    size, rest = F.col("size").cast("double"), (F.col("n") - F.col("size")).cast("double")
    every = balls.select("zone", "radius", "centre", "size", "n").join(k, "zone").join(hits, ["zone", "seed", "radius", "centre"], "left")
    hit = F.coalesce("hit", F.lit(0))
    gap = F.abs(hit / size - (F.col("k") - hit) / rest) / F.sqrt(1 / size + 1 / rest)
    return every.groupBy("zone", "seed").agg(F.max(gap).alias("reach"))


def false_alarms(flags: DataFrame, bins_per_hour: int) -> DataFrame:
    """A zone's false alarms: mean, p95 and most an hour, of windows that fired and of episodes, and the share that fired.

    ``flags`` is (zone, t, fired), t in bins; an hour is ``bins_per_hour`` of them, and an episode starts anew in each.
    """
    hour = F.floor(F.col("t") / bins_per_hour).alias("hour")
    hourly = episodes(flags.select("zone", "t", "fired", hour), "zone", "hour")
    stats = [f(F.col(c)).alias(f"{c}_{n}") for c in ("fired", "episodes") for n, f in (("mean", F.avg), ("p95", lambda x: F.percentile(x, F.lit(0.95))), ("most", F.max))]
    return hourly.groupBy("zone").agg(F.count(F.lit(1)).alias("hours"), *stats, (F.sum("fired") / F.sum("windows")).alias("share"))


def knees(curve: DataFrame) -> DataFrame:
    """(lower, upper) of a curve (x, dispersion, retained): the first x at which zones agree to within 1.5, the last that keeps half at most."""
    return curve.agg(F.min(F.when(F.col("dispersion") <= 1.5, F.col("x"))).alias("lower"), F.max(F.when(F.col("retained") <= 0.5, F.col("x"))).alias("upper"))


def flattening(rates: DataFrame, gain: float = 0.05) -> DataFrame:
    """(cut, flat): the first length whose next one, at most twice as long, gains less than ``gain`` in ``scan``; null if none does."""
    line = Window.partitionBy("cut").orderBy("length")
    step = rates.select("cut", "length", F.lead("length").over(line).alias("then"), (F.lead("scan").over(line) - F.col("scan")).alias("more"))
    flat = (F.col("then") <= 2 * F.col("length")) & (F.col("more") < gain)
    return step.groupBy("cut").agg(F.min(F.when(flat, F.col("length"))).alias("flat"))


def criteria(rates: DataFrame, power: float = 0.8, factor: float = 2.0, difference: float = 0.2) -> DataFrame:
    """(cut, length, ratio, difference, wins): the least (cut, length) at which ``scan`` reaches the power, and whether it beats ``meter`` there.

    It wins with at least ``factor`` times the rate and ``difference`` more. No row if no setting has the power.
    """
    first = rates.where(F.col("scan") >= power).orderBy("cut", "length").limit(1)
    ratio, more = F.when(F.col("meter") > 0, F.col("scan") / F.col("meter")).otherwise(float("inf")), F.col("scan") - F.col("meter")
    return first.select("cut", "length", ratio.alias("ratio"), more.alias("difference"), ((ratio >= factor) & (more >= difference)).alias("wins"))


def pick_window(rates: DataFrame, floor: float = 0.5) -> DataFrame:
    """(cut, by_advantage, by_detection, differ): the best length of each cut, of those that detect ``floor`` at least, and of all.

    Ties go to the shorter one; by_advantage is null where no length reaches the floor.
    """
    advantage = F.when(F.col("scan") >= floor, F.struct((F.col("scan") - F.col("meter")).alias("gain"), (-F.col("length")).alias("l")))
    best = rates.groupBy("cut").agg((-F.max(advantage)["l"]).alias("by_advantage"), (-F.max(F.struct("scan", (-F.col("length")).alias("l")))["l"]).alias("by_detection"))
    return best.withColumn("differ", ~F.col("by_advantage").eqNullSafe(F.col("by_detection")))


def mad_thresholds(rows: DataFrame, value: str, *by: str, times: float = 3.0) -> DataFrame:
    """(by, cut): the median and so many times the median distance from it."""
    middle = percentiles(rows, value, {"__m": 0.5}, *by)
    apart = rows.join(middle, list(by)).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    spread = percentiles(apart, "__d", {"__s": 0.5}, *by)
    return middle.join(spread, list(by)).select(*by, (F.col("__m") + times * F.col("__s")).alias("cut"))
