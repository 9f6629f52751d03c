"""IVF as a Spark data source: ``spark.read.format("ivf").load(path)`` and ``df.write.format("ivf").save(path)``.

A reading task takes whole files, found through Spark's own listing, so that any store that Spark reads is
read; the writing side makes one file a task, of the rows (pts, data) that the task holds, and leaves it in
place only when the job commits.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.sources import containers

SCHEMA = "file string, pts bigint, data binary"


def read_ivf(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """file, place, pts, data, error, message of all frames of the files below a path."""
    files = spark.read.format("binaryFile").load(path).withColumnRenamed("path", "file")
    return containers.scan(files, "file", "content", containers.ivf_frames, "pts bigint, data binary", strict)


class IvfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ivf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return IvfReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return IvfWriter(self.options, schema.fieldNames())


def _local(path: str) -> str:
    return path.removeprefix("file://")


class IvfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = _local(options["path"]), int(options.get("maxBytes", 1 << 31))

    def partitions(self) -> list[InputPartition]:
        found = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".ivf"))
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if os.path.getsize(partition.value) > self.most:
            raise ValueError(f"{partition.value} has more than maxBytes")
        with open(partition.value, "rb") as f:
            for pts, data in containers.ivf_frames(f.read()):
                yield partition.value, pts, data


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class IvfWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path = _local(options["path"])
        self.head = struct.pack("<4sHH4sHHII", b"DKIF", 0, 32, b"AV01", *(int(options.get(k, d)) for k, d in (("width", 0), ("height", 0), ("rate", 25), ("scale", 1))))
        self.pts, self.data = columns.index("pts"), columns.index("data")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        to, n = os.path.join(self.path, f"part-{uuid.uuid4().hex}.ivf"), 0
        with open(f"{to}.tmp", "wb") as f:
            f.write(self.head + bytes(8))
            for row in rows:
                f.write(struct.pack("<IQ", len(row[self.data]), row[self.pts]) + bytes(row[self.data]))
                n += 1
            f.seek(24)
            f.write(struct.pack("<I", n))
        return Written(to)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        for m in messages:
            if m is not None:
                os.replace(f"{m.path}.tmp", m.path)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        for m in messages:
            if m is not None and os.path.exists(f"{m.path}.tmp"):
                os.remove(f"{m.path}.tmp")
