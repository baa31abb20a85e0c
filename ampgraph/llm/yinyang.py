"""Centroid clustering of integer vectors: exact Lloyd rounds that grouped bounds make cheap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize
from .vectors import matrices, pack_rows, unpack_rows

#: Largest component whose squared distances over 64 components are exact as 64-bit integers.
MOST = 2**27
#: Up to this component, products and their sums are exact as doubles.
EXACT_DOUBLE = 2**21
#: Bounds are widened so far that rounding can't make them wrong.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
STATE = "id {kind}, vector binary, cluster int, upper double, lower binary, summary boolean, n long, total array<long>"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT_DOUBLE:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def grouped(c: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of clustering the centroids themselves, from centroids spread by rank."""
    middle = c[np.linspace(0, len(c) - 1, groups).astype(int)].astype(np.float64)
    for _ in range(rounds):
        of = ((c[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (of == g).any():
                middle[g] = c[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


def first_bounds(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound, lower bound of each group's other centroids) after a whole scan."""
    d2 = squared(x, c)
    cluster = d2.argmin(1)  # the first of equal ones
    d = np.sqrt(d2.astype(np.float64))
    upper = d[np.arange(len(x)), cluster] * UP
    d[np.arange(len(x)), cluster] = np.inf
    lower = np.stack([d[:, group == g].min(1) for g in range(group.max() + 1)], 1) * DOWN
    return cluster, upper, lower


def moved_bounds(x, cluster, upper, lower, c, group, drift) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after centroids moved by ``drift``: vectors, then groups, then centroids are left out where bounds allow it."""
    n_groups = group.max() + 1
    before = lower
    upper = (upper + drift[cluster]) * UP
    lower = (before - np.array([drift[group == g].max() for g in range(n_groups)])) * DOWN
    cluster = cluster.copy()
    rows = np.flatnonzero(upper >= lower.min(1))  # global filter
    own = squared_to(x[rows], c[cluster[rows]])
    upper[rows] = np.sqrt(own.astype(np.float64)) * UP
    still = upper[rows] >= lower[rows].min(1)
    rows, own = rows[still], own[still]
    if not len(rows):
        return cluster, upper, lower
    old, was = cluster[rows], own
    best, best_d2 = old.copy(), own.copy()
    scanned = lower[rows] <= upper[rows][:, None]  # group filter
    bound = np.full((len(rows), len(c)), np.inf)  # of every centroid in a scanned group: its distance, or what it can't be below
    for j in range(len(c)):
        within = np.flatnonzero(scanned[:, group[j]] & (old != j))
        least = (before[rows[within], group[j]] - drift[j]) * DOWN
        bound[within, j] = least
        near = within[least <= np.sqrt(best_d2[within].astype(np.float64)) * UP]
        d2 = squared_to(x[rows[near]], c[j])
        bound[near, j] = np.sqrt(d2.astype(np.float64)) * DOWN
        wins = (d2 < best_d2[near]) | ((d2 == best_d2[near]) & (j < best[near]))
        best[near[wins]], best_d2[near[wins]] = j, d2[wins]
    every = np.arange(len(rows))
    bound[every, old] = np.sqrt(was.astype(np.float64)) * DOWN
    bound[every, best] = np.inf
    for g in range(n_groups):
        of_group = bound[:, group == g].min(1)
        lower[rows, g] = np.where(scanned[:, g], of_group, np.minimum(lower[rows, g], of_group))
    cluster[rows] = best
    upper[rows] = np.sqrt(best_d2.astype(np.float64)) * UP
    return cluster, upper, lower


def squared_to(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its own row of ``c``, or to the one row ``c``."""
    return ((x - c) ** 2).sum(1)


def _state(ids, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    n = len(x)
    columns = [ids, pack_rows(x.astype(np.int32)), pa.array(cluster, pa.int32()), pa.array(upper), pack_rows(lower)]
    empty = [pa.array([False] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns + empty, names=["id", "vector", "cluster", "upper", "lower", "summary", "n", "total"])


class _Sums:
    """Counts and component sums of the clusters of one task."""

    def __init__(self, k: int, dim: int):
        self.n, self.total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)

    def add(self, x: np.ndarray, cluster: np.ndarray) -> None:
        for j in np.unique(cluster):
            self.n[j] += (cluster == j).sum()
            self.total[j] += x[cluster == j].sum(0)

    def batch(self, kind) -> pa.RecordBatch:
        j = np.flatnonzero(self.n)
        none = [pa.nulls(len(j), t) for t in (kind, pa.binary(), pa.float64(), pa.binary())]
        columns = [none[0], none[1], pa.array(j, pa.int32()), none[2], none[3], pa.array([True] * len(j)), pa.array(self.n[j]), pa.array(self.total[j].tolist(), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["id", "vector", "cluster", "upper", "lower", "summary", "n", "total"])


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024, groups: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``dim`` finite components.

    Components become floor(scale * x). Centroids start as the vectors with the least sha256 of ``seed:id``; each round
    assigns every vector to its nearest centroid, the smaller number on ties, and moves centroids to the floor of
    their means. Yinyang filtering: centroids are grouped once (``groups``, a quarter of them by default); a vector
    keeps an upper bound to its own centroid and one lower bound for each group. Bounds move with the centroids, and a
    vector, a group or a centroid is looked at only where they don't settle it. Distances are exact integers.

    Every round is one pass over a table of vectors and bounds in the shared folder, which replaces the one before it;
    sums come out of the same pass, one row for each cluster and task, and meet by partial aggregation. The driver
    sees ``clusters`` rows. Vectors that are null, of another length, or hold a null or non-finite component take no
    part; fewer vectors than clusters give fewer clusters. Rows that repeat an id each count (as centroids, equal hashes
    start in the order of their components, null ids last); an empty table gives an empty one; further columns are
    ignored. Components beyond 2^27 after scaling are an error, as their distances have no exact 64-bit form.
    """
    kind = dict(vectors.dtypes)[id_column]
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") == dim)).where(finite)
    start = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "vector").limit(clusters).collect()
    c = np.array([_scaled(np.array(r["vector"], np.float64)[None], scale)[0] for r in start], np.int64).reshape(-1, dim)
    if not len(c):
        return rows.select(F.col("id").alias("vec_id"), *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    group = grouped(c, min(len(c), groups or -(-len(c) // 4)))
    schema = STATE.format(kind=kind)

    def begin(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, arrow = _Sums(len(c), dim), pa.int64()
        for batch in it:
            arrow = batch.column(0).type
            for at, values in matrices(batch.column(1)).values():
                x = _scaled(values, scale)
                found = first_bounds(x, c, group)
                sums.add(x, found[0])
                yield _state(batch.column(0).take(pa.array(at)), x, *found)
        yield sums.batch(arrow)

    state = materialize(map_batches(rows, begin, schema), "bounds")
    for _ in range(rounds):
        moved = _moved(state, c)
        if (moved == c).all():
            break
        drift = np.sqrt(squared_to(moved, c).astype(np.float64)) * UP
        c = moved
        after = materialize(map_batches(state.where("not summary").select("id", "vector", "cluster", "upper", "lower"), _advance(c, group, drift, dim), schema), "bounds")
        discard(state)
        state = after

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                x, of = unpack_rows(batch.column(1), np.int32).astype(np.int64), batch.column(2)
                d2 = squared_to(x, c[of.to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column(0), of, pa.array(d2)], names=["vec_id", "cluster", "distance"])

    placed = materialize(map_batches(state.where("not summary").select("id", "vector", "cluster"), measure, f"vec_id {kind}, cluster int, distance long"), "clusters")
    discard(state)
    return placed.join(F.broadcast(_totals(placed, c)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _scaled(x: np.ndarray, scale: int) -> np.ndarray:
    y = np.floor(x * scale)
    if np.abs(y).max(initial=0) > MOST:
        raise ValueError(f"a component exceeds {MOST} after scaling: squared distances would not fit 64 bits")
    return y.astype(np.int64)


def _advance(c: np.ndarray, group: np.ndarray, drift: np.ndarray, dim: int):
    def advance(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, arrow = _Sums(len(c), dim), pa.int64()
        for batch in it:
            arrow = batch.column(0).type
            if not batch.num_rows:
                continue
            x = unpack_rows(batch.column(1), np.int32).astype(np.int64)
            lower = unpack_rows(batch.column(4), np.float64)
            found = moved_bounds(x, batch.column(2).to_numpy(), batch.column(3).to_numpy(), lower, c, group, drift)
            sums.add(x, found[0])
            yield _state(batch.column(0), x, *found)
        yield sums.batch(arrow)

    return advance


def _moved(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """Centroids at the exact floor of their clusters' means; those of empty clusters stay."""
    sums = state.where("summary").select("cluster", "n", F.posexplode("total").alias("at", "x"))
    wide = "decimal(38,0)"
    rows = sums.groupBy("cluster", "at").agg(F.sum(F.col("n").cast(wide)).alias("n"), F.sum(F.col("x").cast(wide)).alias("x")).collect()
    moved = c.copy()
    for r in rows:
        moved[r["cluster"], r["at"]] = int(r["x"]) // int(r["n"])
    return moved


def _totals(placed: DataFrame, c: np.ndarray) -> DataFrame:
    """A row for each cluster that has vectors: as many as clusters, so that it can be broadcast."""
    rows = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = sum(int(r["s"]) for r in rows)
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return placed.sparkSession.createDataFrame([(r["cluster"], int(r["s"]), whole, sha[r["cluster"]]) for r in rows], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def oracle_sql(clusters: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> str:
    """Plain Lloyd rounds as one DuckDB statement."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim})""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {clusters}))""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min_by(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN (
    SELECT c, list(x ORDER BY i) AS x FROM (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v JOIN a{i} USING (r)) GROUP BY c, i)) GROUP BY c) m ON m.c = c{i}.c)""")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (r) JOIN c{rounds} k USING (c)"""
    )
