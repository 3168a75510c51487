"""A Spark data source for task work folders (S20): ``spark.read.format("task_logs")``.

Spark's own file sources skip names that start with a dot, which the logs
``work/<2 hex>/<rest>/.command.{sh,out,err}`` have. This source has one input partition for
each two-digit prefix folder that exists; its reader walks the folder one task directory at a
time and hands files over in batches of bounded size, so neither the listing nor the contents
of a prefix are held whole. Options: ``path`` (a URI; without a scheme it lies on the session's
default filesystem, see ``task_logs``), ``max_bytes`` (larger files come without content).

Rows: ``task_hash`` (``ab/cdef12``), ``log_type``, ``content`` (UTF-8, replacement characters),
``path``, ``length``, ``reason`` (why there is no content: ``over size`` or ``not a task
folder``; null otherwise).
"""
from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import default_root

SCHEMA = "task_hash string, log_type string, content string, path string, length long, reason string"
NAMES = (".command.sh", ".command.out", ".command.err")
BATCH_BYTES = 8 << 20
_PLACE = re.compile(r"/([0-9a-f]{2})/([0-9a-f]{6})[0-9a-f]*/\.command\.(sh|out|err)$")


class Prefix(InputPartition):
    def __init__(self, prefix: str):
        super().__init__(prefix)


class TaskLogReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.max_bytes = int(options["max_bytes"]) if options.get("max_bytes") else None

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs
        fs, base = pafs.FileSystem.from_uri(self.root)
        there = {i.base_name for i in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
                 if i.type == pafs.FileType.Directory}
        return [Prefix(f"{k:02x}") for k in range(256) if f"{k:02x}" in there] or [Prefix("")]

    def _files(self, prefix: str) -> Iterator:
        """The log files of a prefix, one directory listed at a time."""
        import pyarrow.fs as pafs
        fs, base = pafs.FileSystem.from_uri(self.root)
        todo = [f"{base}/{prefix}"] if prefix else []
        while todo:
            for info in fs.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)):
                if info.type == pafs.FileType.Directory:
                    todo.append(info.path)
                elif info.base_name in NAMES:
                    yield fs, info

    def read(self, partition: InputPartition):
        import pyarrow as pa
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows: list[tuple] = []
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for fs, info in self._files(partition.value):
            place = _PLACE.search(info.path)
            reason = ("not a task folder" if place is None else
                      "over size" if self.max_bytes is not None and info.size > self.max_bytes else None)
            text = None
            if reason is None:
                with fs.open_input_stream(info.path, compression=None) as f:
                    text = f.read().decode("utf-8", "replace")
                held += len(text)
            rows.append((place and f"{place[1]}/{place[2]}", place and place[3], text, info.path, info.size, reason))
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class TaskLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "task_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TaskLogReader(self.options)


def task_logs(spark: SparkSession, work_dir: str, max_bytes: int | None = None) -> DataFrame:
    """Register the source and read a work folder with it."""
    spark.dataSource.register(TaskLogSource)
    path = work_dir if "://" in work_dir else default_root(spark) + work_dir
    reader = spark.read.format("task_logs").option("path", path)
    return (reader.option("max_bytes", max_bytes) if max_bytes is not None else reader).load()
