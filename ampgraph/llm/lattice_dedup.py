"""Embedding near-dedup by lattice hashing.

Each table projects unit vectors on 8 random orthonormal directions, shifts them, and decodes the nearest
point of the E8 lattice, whose hash is the vector's home cell. Every vector is also a guest in the
neighbouring cells that lie nearest to it. Vectors that share a cell are verified by cosine.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_links
from .common import map_batches, materialize, mix64, shuffle_partitions
from .components import connected_components
from .vectors import matrices, pack_rows, unit, unpack_rows, usable

#: Tables, neighbouring cells probed in each, and lattice scale for unit vectors. At cosine 0.9 a table's cells
#: are shared with probability 0.39, so 14 tables miss about one link in a thousand; nearer pairs are safer.
TABLES, PROBES, SCALE = 14, 4, 0.45
#: Vectors of a component that are compared at once when its links are counted.
BLOCK = 2048


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the offsets of a cell's neighbours."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [v for s in itertools.product((0.5, -0.5), repeat=8) if sum(v := np.array(s)) % 2 == 0]
    return np.array(whole + half)


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd move the worst coordinate."""
    p = np.rint(y)
    err = y - p
    worst = np.abs(err).argmax(1)
    rows = np.arange(len(y))
    step = np.where(err[rows, worst] >= 0, 1.0, -1.0)
    p[rows, worst] += np.where(p.sum(1) % 2 != 0, step, 0.0)
    return p


def e8_decode(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 + 1/2."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def lattice_keys(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 8) -> np.ndarray:
    """Keys of unit vectors, one row each: for each table the home cell and the ``probes`` nearest neighbours."""
    n, d = x.shape
    if d < 8:
        x, d = np.pad(x, ((0, 0), (0, 8 - d))), 8
    roots = e8_roots()
    keys = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, d])
        axes = np.linalg.qr(rng.normal(size=(d, 8)))[0] * np.sqrt(d / 8)
        y = x @ axes / scale + rng.random(8) * 2
        home = e8_decode(y)
        order = np.argpartition(-(y - home) @ roots.T, probes - 1, axis=1)[:, :probes] if probes else np.empty((n, 0), int)
        cells = np.concatenate([home[:, None], home[:, None] + roots[order]], 1)
        h = np.full((n, 1 + probes), 1 + t + tables * d, np.uint64)
        for i in range(8):
            h = mix64(h ^ (np.rint(cells[:, :, i] * 2).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        keys[:, t] = h
    return keys.reshape(n, -1).view(np.int64)


def lattice_dedup(vectors: DataFrame, threshold: float = 0.9, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Two vectors link where their cosine in double precision is at least ``threshold``. Equal vectors are one
    node from the start. Links found in cells join nodes to components (at most a spanning forest of each cell
    is written, never its pairs); then each component's vectors are compared in blocks, which counts every
    link inside it exactly. n_links counts other rows, component_id is the smallest id reached, kept marks it.

    Null, empty, zero or non-finite vectors, and rows without an id (their component_id is null), link with
    nothing. Vectors of different lengths never link. Rows that repeat an id are rows like any other: each counts
    for itself, equal vectors under one id too. Labels and other columns play no part. An empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
    sound = rows.where(usable("v") & F.col("vec_id").isNotNull())
    classes = materialize(sound.groupBy("v").agg(F.min(F.xxhash64("v")).alias("node"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")), "vector-classes")
    width = int(classes.agg(F.max(F.size("v"))).first()[0] or 1)
    dtype = np.float64 if dict(rows.dtypes)["v"] == "array<double>" else np.float32

    def packed(x: np.ndarray) -> pa.Array:
        return pack_rows(np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(dtype))

    def decode(column: pa.Array) -> np.ndarray:
        x = unpack_rows(column, dtype).astype(np.float64)
        return unit(x) if len(x) else x

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for where, x in matrices(part.column(1)).values():
                    keys = lattice_keys(unit(x), tables, probes, scale)
                    owner = np.repeat(np.arange(len(x)), keys.shape[1])
                    ids = part.column(0).to_numpy(zero_copy_only=False)[where]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids[owner]), packed(x).take(pa.array(owner))], names=["key", "id", "payload"])

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x @ y.T >= threshold

    def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", x, y) >= threshold

    links = bucket_links(map_batches(classes.select("node", "v"), spread, "key long, id long, payload binary"), near, paired, decode)
    roots = materialize(connected_components(links), "vector-roots")
    member = classes.join(roots, "node").select("root", "node", "n", "v")
    blocks = member.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = member.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "v",
    )

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in it:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            key = [held[c].to_numpy() for c in ("root", "i", "j")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            if len(change):
                yield from counted(held.slice(0, int(change[-1])), np.r_[0, change])
                held = held.slice(int(change[-1]))
        if held is not None and held.num_rows:
            yield from counted(held, np.array([0, held.num_rows]))

    def counted(part: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        node, n, own, i, j = (part[c].to_numpy() for c in ("node", "n", "own", "i", "j"))
        column = part["v"].chunk(0) if part["v"].num_chunks else part["v"].combine_chunks()
        x = np.zeros((len(node), width))
        for where, m in matrices(column).values():
            x[where, : m.shape[1]] = unit(m)
        size = np.diff(np.r_[np.asarray(column.offsets)])
        total = np.zeros(len(node), np.int64)
        for a, b in itertools.pairwise(cuts.tolist()):
            if i[a] == j[a]:
                hit = (x[a:b] @ x[a:b].T >= threshold) & (size[a:b, None] == size[a:b])
                np.fill_diagonal(hit, False)
                total[a:b] = hit @ n[a:b]
            else:
                left, right = a + np.flatnonzero(own[a:b] == i[a]), a + np.flatnonzero(own[a:b] == j[a])
                hit = (x[left] @ x[right].T >= threshold) & (size[left][:, None] == size[right])
                total[left], total[right] = hit @ n[right], hit.T @ n[left]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], names=["node", "links"])

    runs = dealt.repartition(shuffle_partitions(vectors.sparkSession), "key").sortWithinPartitions("root", "i", "j").drop("key")
    linked = map_batches(runs, count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        classes.join(roots, "node", "left")
        .join(linked, "node", "left")
        .select("v", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    # tables on both sides of the join, so that a large component can be split between tasks
    known = materialize(known, "vector-links")
    smallest = materialize(known.groupBy("root").agg(F.min("first").alias("component_id")), "vector-components")
    known = known.join(smallest, "root")
    out = sound.join(known, "v").select("vec_id", "n_links", "component_id").unionByName(
        rows.where(~(usable("v") & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
