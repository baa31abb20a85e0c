"""Sharding by histogram sort: splitters from exact counts below refined probes, then one exchange.

Rows are keyed by (hash of text, id), so equal texts are neighbours. Each round broadcasts a few candidate
boundaries per open splitter, counts exactly the bytes and rows between them over all partitions, and narrows
each splitter's interval to the two boundaries around its target, until one meets the tolerance or the
interval holds no further key. A splitter that would fall inside a group of equal texts goes to the group's
edge where the tolerance allows, and otherwise cuts the group by id.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Candidate boundaries per open splitter and round.
PROBES = 32
#: Rows that one cell of the final exchange should hold.
CELL_ROWS = 50_000
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

Key = tuple[int, int]


def cell_of(bounds: list[Key], hash_: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """How many of the ordered ``bounds`` are at or below each key: the number of its cell."""
    first = np.array([b[0] for b in bounds], np.int64)
    cell = np.searchsorted(first, hash_, "right")
    below = np.searchsorted(first, hash_, "left")
    tied = np.flatnonzero(cell > below)
    if len(tied):
        second = np.array([b[1] for b in bounds], np.int64)
        for lo, hi in {(int(below[i]), int(cell[i])) for i in tied}:
            rows = tied[(below[tied] == lo) & (cell[tied] == hi)]
            cell[rows] = lo + np.searchsorted(second[lo:hi], id_[rows], "right")
    return cell


def _cell_column(bounds: list[Key]) -> Column:
    @F.pandas_udf("int")
    def cell(hash_: pd.Series, id_: pd.Series) -> pd.Series:
        return pd.Series(cell_of(bounds, hash_.to_numpy(np.int64), id_.to_numpy(np.int64)), dtype="int32")

    return cell("__hash", "__id") if bounds else F.lit(0)


def _histogram(keys: DataFrame, bounds: list[Key]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each bound."""
    got = keys.groupBy(_cell_column(bounds).alias("cell")).agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    size, rows = (np.zeros(len(bounds) + 1, object) for _ in range(2))
    for r in got:
        size[r["cell"]], rows[r["cell"]] = r["bytes"], r["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def _between(lo: Key, hi: Key, n: int) -> list[Key]:
    """Up to ``n`` keys strictly between two keys: spread over the hashes, or over the ids of one hash."""
    if hi[0] - lo[0] > 1:
        step = hi[0] - lo[0]
        return sorted({(lo[0] + step * i // (n + 1), LOWEST) for i in range(1, n + 1)} - {lo, hi} - {(lo[0], LOWEST)})
    edge = [(hi[0], LOWEST)] if lo[0] < hi[0] and hi[1] > LOWEST else []  # the start of the last hash
    if edge:
        return edge
    top = hi[1] if hi[0] == lo[0] else HIGHEST
    step = top - lo[1]
    return sorted({(lo[0], lo[1] + step * i // (n + 1)) for i in range(1, n + 1)} - {lo, hi})


def splitters(keys: DataFrame, targets: list[int], tolerance: list[int]) -> list[Key]:
    """A key for each target, such that the bytes below it are within the tolerance, or else as near as keys allow."""
    total, n = (int(x or 0) for x in keys.agg(F.sum("__size"), F.count(F.lit(1))).first())
    open_ = {i: (((LOWEST, LOWEST), 0, 0), ((HIGHEST, HIGHEST), total, n)) for i in range(len(targets))}
    done: dict[int, Key] = {}
    while open_:
        asked: set[Key] = set()
        for i, (low, high) in list(open_.items()):
            more = _between(low[0], high[0], PROBES)
            near = min((low, high), key=lambda x: abs(x[1] - targets[i]))
            if abs(near[1] - targets[i]) <= tolerance[i] or high[2] - low[2] <= 1 or not more:
                done[i] = near[0]
                del open_[i]
            else:
                asked.update(more)
        bounds = sorted(asked)
        if not bounds:
            continue
        found = list(zip(bounds, *(x.tolist() for x in _histogram(keys, bounds)), strict=True))
        below = [x[1] for x in found]  # rises with the bounds
        for i, (low, high) in open_.items():
            at, to = bisect.bisect_right(below, targets[i]), bisect.bisect_left(below, targets[i])
            open_[i] = max(low, found[at - 1]) if at else low, min(high, found[to]) if to < len(found) else high
    return [done[i] for i in range(len(targets))]


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with size, shard and slot: contiguous key ranges of nearly equal bytes, slots gapless from 0.

    size is the text's UTF-8 bytes (null: none) plus 8. A shard boundary lies within ``tolerance`` of a shard's
    share of the bytes, or at the nearest key where single rows are larger than that. Finer boundaries cut
    shards into cells of about ``CELL_ROWS`` rows; rows are exchanged once, by cell, and numbered within it, so
    neither a large shard nor a large group of equal texts meets in one task. A null id counts as the lowest;
    rows that repeat text and id are neighbours, in any order; fewer rows than shards leave shards empty.
    Columns of ``docs`` named size, shard or slot are replaced.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    mine = docs.drop("size", "shard", "slot").withColumns(
        {"__size": F.octet_length(text).cast("long") + 8, "__hash": F.xxhash64(text), "__id": F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST))}
    )
    keys = materialize(mine.select("__hash", "__id", "__size"), "shard-keys")
    total, rows = (int(x or 0) for x in keys.agg(F.sum("__size"), F.count(F.lit(1))).first())
    fine = max(1, -(-rows // (shards * CELL_ROWS)))
    targets = [total * j // (shards * fine) for j in range(1, shards * fine)]
    share = total / shards
    allowed = [int(share * (tolerance if j % fine == 0 else 0.2 / fine)) for j in range(1, shards * fine)]
    cuts = splitters(keys, targets, allowed) if total else [(HIGHEST, HIGHEST)] * (shards - 1)
    # a cell's number counts the cuts at or below its keys; equal cuts leave cells between them empty
    bounds = list(itertools.accumulate(cuts, max))
    placed = mine.withColumn("__cell", _cell_column(bounds))
    _, below = _histogram(keys, bounds)
    start = [0, *map(int, below)]
    first = [start[c // fine * fine] for c in range(len(start))]
    offset = F.element_at(F.array(*(F.lit(a - b) for a, b in zip(start, first, strict=True))), F.col("__cell") + 1)
    order = Window.partitionBy("__cell").orderBy("__hash", "__id")
    return (
        placed.withColumn("slot", (F.row_number().over(order) - 1 + offset).cast("long"))
        .withColumn("shard", F.floor(F.col("__cell") / fine).cast("int"))
        .withColumnRenamed("__size", "size")
        .drop("__hash", "__id", "__cell")
    )

