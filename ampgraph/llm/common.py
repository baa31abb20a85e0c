"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import discard, materialize, shared_dir

__all__ = ["discard", "materialize", "shared_dir"]

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows and bytes of text that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow over batches that stay small where texts are long: fewer rows and bytes than Spark's defaults.

    Spark reads both bounds when the plan runs, so they stay lowered in the session; lower ones of its own stay.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(conf.get(key).lower().removesuffix("b"))
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df.mapInArrow(function, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after A-Z became a-z."""
    return text.translate(_LOWER).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (Stafford's variant 13)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stable_order(*columns) -> list:
    """Sort keys that pick rows by a hash of the given columns, the same at every run."""
    return [F.xxhash64(*columns), *columns]
