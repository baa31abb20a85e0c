"""A publisher as a streaming data source: rows (topic, value) out, each batch once or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..errors import PublishError
from ..shipping import ship

FORMAT = "ampgraph_topics"
#: Rows of a staged file that are held at once.
HELD = 1000


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: a file's name, or none where it had no rows, and its rows."""

    name: str | None
    rows: int


class TopicWriter(DataSourceStreamWriter):
    """Tasks stage files; the driver's commit moves them into the batch's folder and then writes the batch's manifest.

    A batch is published once its manifest is there. Of a repeated batch the staged files go and nothing changes; of one
    whose commit broke off, what it had moved is replaced. A task that fails removes its own file, an aborted batch those of
    the other tasks. The folder may be in any file system that pyarrow opens and all executors share.
    """

    def __init__(self, path: str):
        self.path = path

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, root = self._open()
        files.create_dir(f"{root}/_staging", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.json", 0
        try:
            with files.open_output_stream(f"{root}/_staging/{name}") as out:
                for row in iterator:
                    if row["topic"] is None:
                        raise PublishError("a row has no topic")
                    out.write((json.dumps({"topic": row["topic"], "value": row["value"]}, ensure_ascii=False) + "\n").encode())
                    rows += 1
        except BaseException:
            _delete(files, f"{root}/_staging/{name}")
            raise
        if not rows:
            _delete(files, f"{root}/_staging/{name}")
        return Staged(name if rows else None, rows)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        files, root = self._open()
        staged = [m for m in messages if m is not None and m.name]
        manifest, folder = f"{root}/_committed/{batchId}.json", f"{root}/data/batch={batchId}"
        if files.get_file_info(manifest).type != fs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)
        files.create_dir(folder, recursive=True)
        files.create_dir(f"{root}/_committed", recursive=True)
        for n, m in enumerate(staged):
            files.move(f"{root}/_staging/{m.name}", f"{folder}/part-{n:05d}.json")
        with files.open_output_stream(f"{manifest}.tmp") as out:
            out.write(json.dumps({"batch": batchId, "files": len(staged), "rows": sum(m.rows for m in staged)}).encode())
        files.move(f"{manifest}.tmp", manifest)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        files, root = self._open()
        for m in messages:
            if m is not None and m.name:
                _delete(files, f"{root}/_staging/{m.name}")


def _delete(files: fs.FileSystem, path: str) -> None:
    if files.get_file_info(path).type != fs.FileType.NotFound:
        files.delete_file(path)


class Topics(DataSource):
    """``df.writeStream.format("ampgraph_topics").option("path", folder)`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "topic string, value string"

    def streamWriter(self, schema, overwrite: bool) -> TopicWriter:
        if "path" not in self.options:
            raise PublishError("the sink needs a path")
        if missing := {"topic", "value"} - set(schema.names):
            raise PublishError(f"rows need {', '.join(sorted(missing))}")
        return TopicWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Topics)


def published(spark: SparkSession, path: str) -> DataFrame:
    """(batch, topic, value) of all published batches; what is staged, or moved without a manifest, isn't seen."""
    done = spark.read.schema("batch long").json(f"{path}/_committed").select("batch")
    rows = spark.read.schema("topic string, value string, batch long").json(f"{path}/data")
    return rows.join(F.broadcast(done) if done.count() < 100_000 else done, "batch").select("batch", "topic", "value")
