"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Sweeps over the dimensions; exponent that flattens each dimension's token shares to its targets.
ROUNDS, TEMPERATURE = 15, 0.9
#: Sweeps that one plan holds.
PLAN_ROUNDS = 15
#: Up to so many cells, the fitting runs in one task and the weights are broadcast; beyond, both shuffle.
FEW_CELLS = 20_000
SEED = "mix"
#: The share of all tokens that ``mix`` keeps in expectation.
KEEP = 0.8


def words(text: str) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def topic(text: str, n_words: str) -> Column:
    """A document's kind by its surface: web, table, or running text by length."""
    t, n = F.col(text), F.col(n_words)
    return F.when(t.contains("http") | t.contains("@"), "web").when(t.contains("|"), "table").when(n >= 1000, "long").when(n >= 200, "medium").otherwise("short")


def fit_cells(cells: DataFrame, dimensions: tuple[str, ...], rounds: int, temperature: float, gather: Callable[[DataFrame], DataFrame] = lambda df: df, keep: float | None = None, targets: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    """``cells`` (dimensions, tokens) with a factor each, such that tokens * factor has every dimension's target sums.

    ``gather`` is applied to tables that are read back. ``targets`` (dimension, value, weight) gives weights of its
    dimensions' values, which sum to 1; without them a value's target is its token share to the power ``temperature``, scaled to sum to 1 per dimension.

    With ``keep``, targets are tokens that sum to this share of all tokens; a value whose target would be beyond its
    tokens has all of them as its target, and the others share the rest in proportion to that power. Factors are
    held at 1 at most, sweep by sweep, while the other cells are scaled on.

    There are ``rounds`` sweeps; with a ``tolerance`` none after a residual within it, which is looked at each
    ``PLAN_ROUNDS`` sweeps and after the last; a residual beyond it is an error then.
    """
    given = checked_targets(cells, dimensions, targets)
    for d in dimensions:
        if d in given:
            cells = cells.join(given[d], d)
            own = F.col("__weight")
        else:
            own = F.pow(F.sum("tokens").over(Window.partitionBy(d)), F.lit(temperature))
        first = F.row_number().over(Window.partitionBy(d).orderBy(*dimensions)) == 1
        cells = cells.withColumn("__own", own).withColumn("__once", F.when(first, F.col("__own")).otherwise(0.0))
        target = F.col("__own") / F.sum("__once").over(Window.partitionBy("__all"))
        if keep is not None:
            cells = cells.withColumn("__sum", F.sum("tokens").over(Window.partitionBy(d)).cast("double"))
            cells, target = _filled(cells.withColumn("__first", first), d, keep)
        cells = cells.withColumn(f"__target_{d}", target).drop("__weight")
    cells = cells.select(*dimensions, "tokens", "__all", *(f"__target_{d}" for d in dimensions), F.lit(1.0).alias("factor"))
    for sweep in range(rounds):
        for d in dimensions:
            now = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(d))
            scaled = F.col("factor") * F.col(f"__target_{d}") / now
            cells = cells.withColumn("factor", scaled if keep is None else F.least(F.lit(1.0), scaled))
        if (sweep + 1) % PLAN_ROUNDS == 0 and sweep + 1 < rounds:  # keeps the plan short
            cells = gather(materialize(cells, "sweep"))
            if tolerance is not None and residual(cells, dimensions) <= tolerance:
                return cells.select(*dimensions, "tokens", "factor")
    if tolerance is not None:
        cells = gather(materialize(cells, "sweep"))
        if (off := residual(cells, dimensions)) > tolerance:
            raise ValueError(f"after {rounds} sweeps a share is {off:.2g} from its target, beyond the tolerance of {tolerance:.2g}")
    return cells.select(*dimensions, "tokens", "factor")


def checked_targets(cells: DataFrame, dimensions: tuple[str, ...], targets: DataFrame | None) -> dict[str, DataFrame]:
    """By dimension (value, __weight): weights that sum to 1, none negative, one for each value there is and no others."""
    if targets is None:
        return {}
    rows = targets.groupBy("dimension").agg(F.sum("weight").alias("s"), F.min("weight").alias("least"), F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("k")).collect()
    out = {}
    for r in rows:
        d = r["dimension"]
        if d not in dimensions or not abs(r["s"] - 1) < 1e-6 or not r["least"] > 0 or r["n"] != r["k"]:
            raise ValueError(f"target weights of {d}: a known dimension, positive, one a value, with the sum 1")
        own = targets.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("weight").cast("double").alias("__weight"))
        there = cells.select(d).distinct()
        if odd := there.join(own, d, "left_anti").union(own.select(d).join(there, d, "left_anti")).take(1):
            raise ValueError(f"target weights of {d}: {odd[0][0]!r} has a weight or tokens alone")
        out[d] = own
    return out


def residual(cells: DataFrame, dimensions: tuple[str, ...]) -> float:
    """The largest difference, over all dimensions' values, of the share that factors give and the target's share."""
    worst = 0.0
    for d in dimensions:
        sums = cells.groupBy(d).agg(F.sum(F.col("tokens") * F.col("factor")).alias("now"), F.max(f"__target_{d}").alias("goal"))
        total = sums.agg(F.sum("now").alias("a"), F.sum("goal").alias("b"))
        got = sums.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("now") / F.col("a") - F.col("goal") / F.col("b")))).first()[0]
        worst = max(worst, got or 0.0)
    return worst


def _filled(cells: DataFrame, d: str, keep: float) -> tuple[DataFrame, Column]:
    """``cells`` and the target of their value of ``d``: all of its tokens (__sum), or __own times what is left for such values.

    The share that a value's target would be of its tokens falls with its tokens, so the values that get all are
    the smallest ones, and running sums by size find where they end.
    """
    every = Window.partitionBy("__all")
    upto = every.orderBy("__sum", d).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    once = F.when(F.col("__first"), F.col("__sum")).otherwise(0.0)
    left = F.lit(keep) * F.sum("tokens").over(every) - (F.sum(once).over(upto) - F.col("__sum"))
    rest = F.sum("__once").over(every) - F.sum("__once").over(upto) + F.col("__own")
    cells = cells.withColumn("__scale", left / rest).withColumn("__whole", F.col("__scale") * F.col("__own") >= F.col("__sum"))
    cut = F.min(F.when(~F.col("__whole"), F.struct("__sum", d, "__scale"))).over(every)
    cells = cells.withColumn("__cut", cut["__scale"])
    return cells, F.when(F.col("__whole"), F.col("__sum")).otherwise(F.col("__cut") * F.col("__own"))


def mixing_probabilities(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: str = SEED, id_column: str = "doc_id", text_column: str = "text", keep: float | None = None, targets: DataFrame | None = None, tolerance: float | None = None, topic_column: str | None = None) -> DataFrame:
    """``docs`` with __tokens, __topic, __probability and __sampled.

    Token weights (words of the whole text plus one) are counted by cell of source, language and topic over all
    documents, with partial sums before the shuffle, and raked: sweep by sweep each dimension's sums are scaled
    to its targets. A document's probability is its cell's factor over the largest one, so that the sampled tokens
    have the target marginals in expectation and no document counts twice. It is sampled where a hash of its id
    falls under it: the same at every run, and for all rows that repeat an id. With ``keep``, the sampled tokens are
    this share of all tokens in expectation, and a small cell is sampled whole instead of lowering all others.

    ``targets`` (dimension, value, weight) sets any dimension's target weights, with ``tolerance`` for the largest
    difference left in a share; the default targets are the corpus's own shares, flattened. ``topic_column`` names a
    column of topics; by default a topic is a rule on the text's surface. A column of a dimension that ``docs`` lacks
    counts as empty.

    A null or empty text has one token; a null source, language or id counts as an empty string. An empty table
    gives an empty one.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.withColumn("__text", text).withColumn("__n", words("__text"))
    kind = F.coalesce(F.col(topic_column).cast("string"), F.lit("")) if topic_column else topic("__text", "__n")
    rows = rows.withColumns({"__topic": kind, "__tokens": (F.col("__n") + 1).cast("long")}).drop("__text", "__n")
    value = {d: F.col("__topic") if d == "topic" else F.coalesce(F.col(d).cast("string"), F.lit("")) if d in docs.columns else F.lit("") for d in dimensions}
    cells = materialize(rows.groupBy(*(c.alias(d) for d, c in value.items())).agg(F.sum("__tokens").alias("tokens")), "cells")
    few = cells.count() <= FEW_CELLS
    gather = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    fitted = materialize(fit_cells(gather(cells).withColumn("__all", F.lit(1)), dimensions, rounds, temperature, gather, keep, targets, tolerance), "weights")
    most = 1.0 if keep is not None else fitted.agg(F.max("factor")).first()[0] or 1.0
    weights = fitted.select(*(F.col(d).alias(f"__of_{d}") for d in dimensions), (F.col("factor") / F.lit(most)).alias("__probability"))
    on = [value[d] == F.col(f"__of_{d}") for d in dimensions]
    joined = rows.join(F.broadcast(weights) if few else weights, on).drop(*(f"__of_{d}" for d in dimensions))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10)
    return joined.withColumn("__sampled", draw.cast("double") / 4294967296.0 < F.col("__probability"))


def mix(docs: DataFrame, keep: float = KEEP, **options) -> DataFrame:
    """The sampled rows of ``docs``, with its columns; ``keep`` of the tokens in expectation."""
    return mixing_probabilities(docs, keep=keep, **options).where("__sampled").select(*docs.columns)


def oracle_sql(rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: str = SEED) -> str:
    """The same as DuckDB SQL: doc_id, source, lang, topic, tokens, probability, sampled."""
    steps = []
    for d in DIMENSIONS:
        at = "cells" if not steps else f"t{len(steps) - 1}"
        steps.append(f"t{len(steps)} AS (SELECT *, pow(sum(tokens) OVER (PARTITION BY {d}), {temperature}) / (SELECT sum(x) FROM (SELECT pow(sum(tokens), {temperature}) AS x FROM cells GROUP BY {d})) AS target_{d} FROM {at})")
    steps.append("f0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS factor FROM t2)")
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            steps.append(f"f{n + 1} AS MATERIALIZED (SELECT * EXCLUDE factor, factor * target_{d} / sum(tokens * factor) OVER (PARTITION BY {d}) AS factor FROM f{n})")
            n += 1
    return f"""
WITH counted AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n
  FROM documents
), d AS (
  SELECT doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l,
         CASE WHEN contains(t, 'http') OR contains(t, '@') THEN 'web' WHEN contains(t, '|') THEN 'table'
              WHEN n >= 1000 THEN 'long' WHEN n >= 200 THEN 'medium' ELSE 'short' END AS topic,
         n + 1 AS tokens
  FROM counted
), cells AS MATERIALIZED (
  SELECT s AS source, l AS lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL
), {", ".join(steps)}, w AS (SELECT source, lang, topic, factor / (SELECT max(factor) FROM f{n}) AS p FROM f{n})
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens::BIGINT AS tokens, round(w.p, 6) AS probability,
       ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < w.p AS sampled
FROM d JOIN w ON d.s = w.source AND d.l = w.lang AND d.topic = w.topic
"""
