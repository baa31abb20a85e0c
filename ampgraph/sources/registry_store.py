"""The registry as buckets that are rewritten only where a batch touches them, committed by one small file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry

COLUMNS = "device_id string, device_type string, zone string, node string, last_seen_us long, active boolean"


class RegistryStore:
    """Readings appended and the registry folded on, batch by batch, in one folder that driver and executors share.

    ``readings/batch=N`` has a batch's readings, ``registry/version=N/bucket=b`` the buckets of devices that batch N
    touched. ``commits/N.json`` names each bucket's version and is written last, by a rename: readers follow the newest commit, so
    they see a batch whole or not at all, whatever broke off before. A batch id that is committed already changes nothing. A batch's
    cost follows the buckets it touches; versions that the last ``keep`` commits don't name are removed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.buckets, self.keep = spark, path.rstrip("/"), buckets, keep
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self, folder: str, prefix: str = "", suffix: str = "") -> list[int]:
        """Numbers in the names of a folder's entries, ascending: one listing."""
        if not self._fs.exists(self._at(folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]
        found = (n.removeprefix(prefix).removesuffix(suffix) for n in names if n.startswith(prefix) and n.endswith(suffix))
        return sorted(int(n) for n in found if n.isdigit())

    def commits(self) -> list[int]:
        return self._numbers("commits", suffix=".json")

    def _versions(self, commit: int) -> dict[int, int]:
        text = self.spark.read.text(f"{self.path}/commits/{commit}.json", wholetext=True).first()[0]
        return {int(b): v for b, v in json.loads(text)["buckets"].items()}

    def _folders(self, versions: dict[int, int]) -> list[str]:
        return [f"{self.path}/registry/version={v}/bucket={b}" for b, v in sorted(versions.items())]

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        return self.spark.read.schema(COLUMNS).parquet(*self._folders(versions)) if versions else self.spark.createDataFrame([], COLUMNS)

    def registry(self) -> DataFrame:
        """The registry as of the newest commit."""
        done = self.commits()
        return self._rows(self._versions(done[-1]) if done else {})

    def readings(self, schema: str) -> DataFrame:
        """The readings of committed batches."""
        done = self.commits()
        if not done:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/readings")
        return rows.join(self.spark.createDataFrame([(n,) for n in done], "batch long"), "batch", "left_semi").drop("batch")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A foreachBatch function."""
        done = self.commits()
        if batch_id in done:
            return
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{self.path}/readings/batch={batch_id}")
            bucket = F.pmod(F.xxhash64("device_id"), F.lit(self.buckets)).cast("int").alias("bucket")
            fold = registry.upsert(batch)
            touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
            before = self._versions(done[-1]) if done else {}
            merged = registry.merge(self._rows({b: v for b, v in before.items() if b in touched}), fold)
            rows = merged.select("device_id", "device_type", "zone", "node", "last_seen_us", "active", bucket)
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/registry/version={batch_id}")
        finally:
            batch.unpersist()
        self._commit(batch_id, before | dict.fromkeys(touched, batch_id))
        self._prune()

    def _commit(self, batch_id: int, versions: dict[int, int]) -> None:
        draft, final = self._at(f"commits/_{batch_id}"), self._at(f"commits/{batch_id}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"buckets": versions}).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"commit {batch_id} could not be renamed")

    def _prune(self) -> None:
        """Remove buckets that no kept commit names. Readers of older commits are given ``keep`` batches of time."""
        named = {(b, v) for n in self.commits()[-self.keep :] for b, v in self._versions(n).items()}
        for v in self._numbers("registry", "version="):
            held = [b for b in self._numbers(f"registry/version={v}", "bucket=")]
            gone = [b for b in held if (b, v) not in named]
            if len(gone) == len(held):
                self._fs.delete(self._at(f"registry/version={v}"), True)
            else:
                for b in gone:
                    self._fs.delete(self._at(f"registry/version={v}/bucket={b}"), True)
