"""Links inside buckets: rows sorted by key, compared within the runs of equal keys.

Each bucket gives links that connect what its pairwise links would connect, never all of its pairs.
Buckets over ``BLOCK`` rows are cut into blocks; each pair of blocks becomes a task's group of its own,
so that no bucket, however large, is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, shuffle_partitions

#: Rows of a bucket that one comparison holds at once.
BLOCK = 4096
#: Runs up to this length are compared by shifted arrays, all runs of a batch at once.
SHORT = 12

#: near(rows, others): a boolean matrix for two payload matrices; paired(x, y): a boolean for each row of both.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def bucket_links(rows: DataFrame, near: Near, paired: Near, decode: Callable[[pa.Array], np.ndarray], seeds: int = 64) -> DataFrame:
    """(a, b) long links with a < b from ``rows`` (key long, id long, payload); rows without a key are ignored.

    The result connects two ids if and only if a chain of near ids that share buckets does. ``decode`` makes a
    matrix of a payload column. ``seeds`` is 1 where a comparison is dear, so that groups of near rows cost few.
    """
    n = shuffle_partitions(rows.sparkSession)
    kind = dict(rows.dtypes)["payload"]
    runs = rows.select("key", "id", "payload").where("key is not null").repartition(n, "key").sortWithinPartitions("key")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int32()), ("payload", _arrow(kind))])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        block, large = 0, None  # blocks given so far of the run that is too large, and its key
        for part in gathered(it):
            held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            while held.num_rows:
                keys = held["key"].to_numpy()
                last = int(np.searchsorted(keys, keys[-1]))
                if block and keys[0] != large:
                    block = 0
                if last and block:
                    end = int(np.searchsorted(keys, large, "right"))
                    yield overflow(held.slice(0, end), block, schema)
                    held, block = held.slice(end), 0
                elif last:
                    yield from within(held.slice(0, last), schema)
                    held = held.slice(last)
                elif held.num_rows > BLOCK:
                    yield overflow(held.slice(0, BLOCK), block, schema)
                    held, block, large = held.slice(BLOCK), block + 1, keys[0]
                else:
                    break
        if held is not None and held.num_rows:
            if block and held["key"][0].as_py() == large:
                yield overflow(held, block, schema)
            else:
                yield from within(held, schema)

    def within(part: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        keys = part["key"].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[starts, len(keys)])
        many = np.repeat(size > 1, size)
        if not many.any():
            return
        ids = part["id"].to_numpy()[many]
        data = decode(part["payload"].combine_chunks().filter(pa.array(many)))
        run = np.repeat(np.arange(len(size)), size)[many]
        found = [np.empty((0, 2), np.int64)]
        for lag in range(1, SHORT):
            x = np.flatnonzero(run[lag:] == run[:-lag]) if lag < len(run) else np.empty(0, int)
            x = x[size[run[x]] <= SHORT]
            if not len(x):
                break
            for at in range(0, len(x), 65536):
                y = x[at : at + 65536]
                y = y[paired(data[y], data[y + lag])]
                found.append(np.stack([ids[y], ids[y + lag]], 1))
        for r in np.flatnonzero(size > SHORT):
            at = slice(np.searchsorted(run, r), np.searchsorted(run, r, "right"))
            found.append(ids[at][spanning(data[at], near, seeds)])
        yield edges(np.concatenate(found), schema)

    both = materialize(map_batches(runs, scan, f"a long, b long, key long, block int, payload {kind}"), "buckets")
    links = both.where("a is not null").select("a", "b")
    large = both.where("block is not null").select("key", "block", "payload", F.col("b").alias("id"))
    if not large.take(1):
        return links.distinct()
    count = large.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    dealt = large.join(count, "key").select(
        "key", "id", "payload", F.col("block").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    dealt = dealt.where("own != other").select("key", "id", "payload", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        data = decode(pa.array(pdf["payload"], type=_arrow(kind)))
        ids = pdf["id"].to_numpy()
        found = ids[spanning(data, near, seeds)].reshape(-1, 2)
        return pd.DataFrame({"a": found.min(1), "b": found.max(1)})

    more = dealt.groupBy("key", "i", "j").applyInPandas(across, "a long, b long")
    return links.unionByName(more).where("a != b").distinct()


def gathered(it: Iterator[pa.RecordBatch], rows: int = 16_384, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``rows`` rows or ``size`` bytes."""
    some: list[pa.RecordBatch] = []
    for batch in it:
        some.append(batch)
        if sum(b.num_rows for b in some) >= rows or sum(b.nbytes for b in some) >= size:
            yield pa.Table.from_batches(some)
            some = []
    if some:
        yield pa.Table.from_batches(some)


def spanning(data: np.ndarray, near: Near, seeds: int = 1, step: int = 64) -> np.ndarray:
    """Pairs of row numbers: links that connect what the graph of near rows connects, found breadth first.

    The search begins at ``seeds`` rows at once, each the root of a tree; rows that no other is near to so cost a
    part of a comparison, not one each. Trees that meet become one: a row reached is compared with what is still
    unreached, and with unfinished rows only while those are of other trees.
    """
    root = list(range(len(data)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def join(pairs) -> Iterator[tuple[int, int]]:
        for i, j in pairs:
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                yield i, j

    rest, found = np.arange(len(data)), []
    while len(rest) > 1:
        front, rest = rest[:seeds], rest[seeds:]
        while len(front):
            now, front = front[:step], front[step:]
            tree = np.array([find(i) for i in now.tolist()])
            open_ = np.concatenate([now, front])
            of_open = np.array([find(i) for i in open_.tolist()])
            if (of_open != of_open[0]).any():
                hit = near(data[now], data[open_]) & (tree[:, None] != of_open)
                if hit.any():
                    at = np.unique(np.stack([tree[np.nonzero(hit)[0]], of_open[np.nonzero(hit)[1]], *np.nonzero(hit)]), axis=1)
                    _, first = np.unique(at[:2], axis=1, return_index=True)  # one link for each pair of trees
                    found += join((int(now[i]), int(open_[j])) for i, j in at[2:, first].T)
                    tree = np.array([find(i) for i in now.tolist()])
            if not len(rest):
                continue
            hit = near(data[now], data[rest])
            got = hit.any(0)
            if not got.any():
                continue
            hit, new = hit[:, got], rest[got]
            first = hit.argmax(0)
            found += join(zip(now[first].tolist(), new.tolist(), strict=True))
            i, j = np.nonzero(hit & (tree[:, None] != tree[first]))
            if len(i):
                _, once = np.unique(np.stack([tree[i], tree[first[j]]]), axis=1, return_index=True)
                found += join(zip(now[i[once]].tolist(), new[j[once]].tolist(), strict=True))
            front, rest = np.concatenate([front, new]), rest[~got]
    return np.array(found, np.int64).reshape(-1, 2)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "binary": pa.binary()}[kind]


def edges(pairs: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    pairs = np.unique(np.sort(pairs, 1)[pairs[:, 0] != pairs[:, 1]], axis=0)
    n = len(pairs)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.nulls(n, schema.field(i).type) for i in (2, 3, 4))], schema=schema)


def overflow(part: pa.Table, block: int, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of a bucket that goes on in other blocks; b holds the row's id."""
    n = part.num_rows
    part = part.combine_chunks()
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), _one(part["id"]), _one(part["key"]), pa.array(np.full(n, block, np.int32)), _one(part["payload"]).cast(schema.field(4).type)], schema=schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
