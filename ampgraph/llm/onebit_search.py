"""Inner-product search with randomly rotated one-bit codes.

A vector's residual from the centre is scaled to length 1 and rotated; its code is the signs of the rotated
components, with two correction scalars: the residual's length, and the inner product of code and rotated
residual. A query's rotated components are rounded to a few bit planes, so a code's inner product with it is
counted from packed bits; divided by the correction it estimates the true one, within an error bound that
holds with overwhelming probability. Only vectors whose bound reaches the k-th best exact score so far are
reranked by their exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .vectors import matrices, pack_rows, unpack_rows, usable

#: Vectors and queries that one task compares.
VECTORS, QUERIES = 16_384, 2048
#: Bit planes of a rounded query; width of the error bound in standard errors.
PLANES, WIDTH = 6, 3.0
#: Queries estimated at once.
AT_ONCE = 16


def rotation(d: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (rows of 64-bit words), residual lengths, and inner products of code and residual."""
    rest = x - centre
    length = np.sqrt((rest * rest).sum(1))
    y = rest @ turn / np.where(length > 0, length, 1)[:, None]
    bits = np.packbits(y > 0, axis=1, bitorder="little")
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
    return np.ascontiguousarray(bits).view("<u8"), length, np.abs(y).sum(1) / np.sqrt(x.shape[1])


def estimates(q: np.ndarray, centre: np.ndarray, turn: np.ndarray, bits: np.ndarray, length: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries and coded vectors, and how far the true ones may be."""
    d = q.shape[1]
    y = q @ turn
    low = y.min(1, keepdims=True)
    step = np.maximum((y.max(1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
    whole = np.rint((y - low) / step).astype(np.uint8)
    inside = np.zeros((len(q), len(bits)), np.int64)
    for p in range(PLANES):
        plane = np.packbits(whole >> p & 1, axis=1, bitorder="little")
        plane = np.ascontiguousarray(np.pad(plane, ((0, 0), (0, -plane.shape[1] % 8)))).view("<u8")
        for w in range(bits.shape[1]):
            inside += np.bitwise_count(plane[:, w, None] & bits[None, :, w]).astype(np.int64) << p
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
    near = low + step * whole
    code = (2 * (step * inside + low * ones) - near.sum(1, keepdims=True)) / np.sqrt(d)  # code and rounded query
    align = np.maximum(align, 1e-12)
    estimate = (q @ centre)[:, None] + length * code / align
    rounding = np.abs(y - near).sum(1, keepdims=True) / np.sqrt(d)
    spread = np.sqrt(np.maximum(1 - align**2, 0) / max(d - 1, 1))
    norm = np.sqrt((y * y).sum(1, keepdims=True))
    return estimate, length / align * (rounding + WIDTH * norm * spread) + 1e-9 * (1 + np.abs(estimate))


def search_block(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, coded: tuple, centre: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vector number, exact score): each query's k best of this block, ties to smaller ids."""
    turn, out = rotation(q.shape[1]), []
    for at in range(0, len(q), AT_ONCE):
        estimate, error = estimates(q[at : at + AT_ONCE], centre, turn, *coded)
        for i, (e, r) in enumerate(zip(estimate, error, strict=True)):
            e[x_id == q_id[at + i]] = -np.inf
            some = min(len(e), 4 * k)
            first = np.argpartition(-e, some - 1)[:some]
            known = np.sort((x[first] * q[at + i]).sum(1)[np.isfinite(e[first])])
            least = known[-k] if len(known) >= k else -np.inf
            rows = np.flatnonzero((e + r >= least) & np.isfinite(e))
            score = (x[rows] * q[at + i]).sum(1)
            best = np.lexsort((x_id[rows], -score))[:k]
            out.append((np.full(len(best), at + i), rows[best], score[best]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def onebit_search(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows by inner product, nearest first.

    Every sound row is indexed. Vectors and queries meet in a grid of blocks of about ``VECTORS`` by ``QUERIES``
    rows, so no task grows with the table; the k best of each block are merged by a window whose partial limits
    run before its exchange. The score is the exact inner product in double precision; ties go to the smaller id.

    Null, empty, zero or non-finite vectors and rows without an id take no part; vectors of other lengths are no
    candidates. A query's own id is no candidate. Of queries that repeat an id one counts. Fewer candidates than
    ``k`` are all returned. An empty table gives an empty one. Other columns play no part.
    """
    rows = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False))).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), "__query"
    )
    rows = rows.where(usable("v") & F.col("id").isNotNull())
    means = rows.select(F.size("v").alias("d"), F.posexplode("v").alias("at", "x")).groupBy("d", "at").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    centres = {d: np.array([m for _, m in sorted((r["at"], r["m"]) for r in means if r["d"] == d)]) for d in {r["d"] for r in means}}

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for d, (where, x) in matrices(batch.column(1)).items():
                bits, length, align = encode(x, centres[d], rotation(d))
                take = pa.array(where)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(2).take(take), pa.array(np.full(len(x), d, np.int32)), pack_rows(bits), pa.array(length), pa.array(align), pack_rows(x)],
                    names=["id", "query", "d", "bits", "length", "align", "v"],
                )

    indexed = materialize(map_batches(rows, index, "id long, query boolean, d int, bits binary, length double, align double, v binary"), "onebit-index")
    n, m = indexed.agg(F.count(F.lit(1)), F.count_if("query")).first()
    g, h = max(1, -(-n // VECTORS)), max(1, -(-m // QUERIES))
    queries = indexed.where("query").groupBy("d", "id").agg(F.min("v").alias("v"))
    left = indexed.select("d", F.pmod(F.xxhash64("id", "v"), F.lit(g)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(h - 1).cast("long"))).alias("j"), "id", "bits", "length", "align", "v")
    right = queries.select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("id"), F.lit(h)).alias("j"), "id", "v")

    def meet(key: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        coded = unpack_rows(x["bits"], "<u8"), x["length"].to_numpy(), x["align"].to_numpy()
        x_id, q_id = x["id"].to_numpy(), q["id"].to_numpy()
        i, j, score = search_block(unpack_rows(q["v"], "<f8"), q_id, unpack_rows(x["v"], "<f8"), x_id, coded, centres[key[0]], k)
        return pd.DataFrame({"query_id": q_id[i], "vec_id": x_id[j], "score": score})

    found = left.groupBy("d", "i", "j").cogroup(right.groupBy("d", "i", "j")).applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
