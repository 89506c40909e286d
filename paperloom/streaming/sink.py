"""A sink of lines in topics: each batch appears whole and once.

Tasks write their lines to drafts of their own. The batch's commit moves the drafts of the tasks that
succeeded into one folder and renames it to the batch's name; a batch that is there already is not
written again, and drafts of failed tasks are never seen. Consumers read a topic's folders as a stream of
files. The engine notes a batch as done after its commit, so nothing is acknowledged that isn't there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

LINES = "topic string, value string"


@dataclass
class _Written(WriterCommitMessage):
    drafts: dict[str, str]  # of each topic


class _Topics:
    """What the batch writer and the stream writer share."""

    def __init__(self, path: str):
        self._path, self._run = path.rstrip("/"), uuid.uuid4().hex

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self._path) if "://" in self._path else (fs.LocalFileSystem(), self._path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, root = self._system()
        drafts: dict[str, str] = {}
        files: dict[str, object] = {}
        try:
            for row in iterator:
                if row["topic"] not in files:
                    system.create_dir(f"{root}/_drafts/{self._run}", recursive=True)
                    drafts[row["topic"]] = f"{root}/_drafts/{self._run}/{uuid.uuid4().hex}"
                    files[row["topic"]] = system.open_output_stream(drafts[row["topic"]])
                files[row["topic"]].write(f"{row['value']}\n".encode())
        finally:
            for f in files.values():
                f.close()
        return _Written(drafts)

    def _publish(self, messages: list, batch: str) -> None:
        system, root = self._system()
        topics = sorted({t for m in messages if m for t in m.drafts})
        for topic in topics:
            final = f"{root}/topic={topic}/batch={batch}"
            if system.get_file_info(final).type != fs.FileType.NotFound:
                continue
            whole = f"{root}/_drafts/{self._run}/{topic}-{batch}"
            system.create_dir(whole, recursive=True)
            for k, m in enumerate(messages):
                if m and topic in m.drafts:
                    system.move(m.drafts[topic], f"{whole}/part-{k:05d}.json")
            system.create_dir(f"{root}/topic={topic}", recursive=True)
            system.move(whole, final)
        self._drop(messages)

    def _drop(self, messages: list) -> None:
        system, _ = self._system()
        for draft in (d for m in messages if m for d in m.drafts.values()):
            if system.get_file_info(draft).type == fs.FileType.File:
                system.delete_file(draft)


class _StreamTopics(_Topics, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._publish(messages, str(batchId))

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._drop(messages)


class _BatchTopics(_Topics, DataSourceWriter):
    def __init__(self, path: str, batch: str):
        super().__init__(path)
        self._batch = batch

    def commit(self, messages: list) -> None:
        self._publish(messages, self._batch)

    def abort(self, messages: list) -> None:
        self._drop(messages)


class TopicSink(DataSource):
    """``path``: the folder of the topics; for a batch write also ``batch``, its name."""

    @classmethod
    def name(cls) -> str:
        return "paper_topics"

    def schema(self) -> str:
        return LINES

    def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamTopics(self.options["path"])

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _BatchTopics(self.options["path"], self.options["batch"])


def registered(spark: SparkSession) -> str:
    """The sink's name, for ``format``."""
    spark.dataSource.register(TopicSink)
    return TopicSink.name()


def publish(lines: DataFrame, path: str, batch: int | str) -> None:
    """Add lines (topic, value) as one batch, unless it is there already."""
    lines.select("topic", "value").write.format(registered(lines.sparkSession)).option("path", path).option("batch", str(batch)).mode("append").save()
