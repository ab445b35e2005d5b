"""A live channel of lines as a streaming source: a file that a tool appends its messages to, such as a log or the file behind a named pipe.

An offset is the number of bytes that end with the last whole line; so a line is read once it is complete, and once only. A batch is the bytes between two
offsets, cut into ranges that tasks read side by side: a line belongs to the range in which it begins. After a restart the checkpoint says where to go on, and
a batch that was not committed is read again, the same bytes. The file must be one that executors can open under the same path."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.telemetry import parse_activity

#: Bytes that one task reads.
RANGE = 16 << 20
#: Bytes read at a time when the last line feed is looked for.
STEP = 64 << 10


class _Range(InputPartition):
    def __init__(self, begin: int, end: int, stop: int) -> None:
        self.begin, self.end, self.stop = begin, end, stop


class LineReader(DataSourceStreamReader):
    """ord (the byte at which a line begins, so it grows with the file) and value."""

    def __init__(self, path: str, size: int = RANGE) -> None:
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def latestOffset(self) -> dict:
        """Behind the last line feed; a file that is not there yet is empty."""
        if not os.path.exists(self.path):
            return {"bytes": 0}
        with open(self.path, "rb") as f:
            at = f.seek(0, os.SEEK_END)
            while at > 0:
                begin = max(0, at - STEP)
                f.seek(begin)
                if (k := f.read(at - begin).rfind(b"\n")) >= 0:
                    return {"bytes": begin + k + 1}
                at = begin
        return {"bytes": 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        begin, stop = start["bytes"], end["bytes"]
        if stop < begin:
            raise ValueError(f"{self.path} is shorter than what has been read of it: it was replaced, not appended to")
        return [_Range(k, min(k + self.size, stop), stop) for k in range(begin, stop, self.size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            at = partition.begin
            if at:  # a line that begins before the range is another's
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing to give back: the file keeps its lines."""


class LineSource(DataSource):
    """Options: path, and range (bytes that a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "ord long, value string"

    def streamReader(self, schema: StructType) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("range", RANGE)))


def line_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """ord, value of the lines that are appended to a file."""
    spark.dataSource.register(LineSource)
    return spark.readStream.format(LineSource.name()).options(path=path, **options).load()


def activity_channel(spark: SparkSession, path: str, **options) -> DataFrame:
    """Messages of activity that are appended to a file, with ord, their place in it."""
    return parse_activity(line_stream(spark, path, **options))
