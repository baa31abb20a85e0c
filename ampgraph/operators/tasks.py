"""How few and small rows that each stand for much work are laid out over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` in hash partitions of a stated number, which adaptive plans don't merge: they go by bytes, not by work."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *by)
