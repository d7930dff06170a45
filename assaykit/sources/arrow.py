"""Arrow IPC files as a Spark data source: a task for each record batch."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import records
from . import storage
from .files import file_error

FORMAT = "assaykit_arrow"


def batch_rows(source) -> list[int]:
    """How many rows each record batch of an Arrow file has, from the file's footer and the head of each batch: to ask a batch
    for it would be to read its columns."""

    def at(where: int, length: int) -> bytes:
        source.seek(where)
        return source.read(length)

    def value(data: bytes, form: str, where: int) -> int:
        return struct.unpack_from(f"<{form}", data, where)[0]

    def field(data: bytes, table: int, number: int) -> int | None:
        """Where a field of a flatbuffer's table is; None if it has the default value."""
        known = table - value(data, "i", table)
        place = 4 + 2 * number
        there = value(data, "H", known + place) if place < value(data, "H", known) else 0
        return table + there if there else None

    def below(data: bytes, where: int) -> int:
        return where + value(data, "I", where)

    # the end of a file: its footer, the footer's length, ARROW1
    size = source.seek(0, 2) or source.tell()
    length = value(at(size - 10, 4), "i", 0)
    footer = at(size - 10 - length, length)
    found, out = field(footer, below(footer, 0), 3), []
    blocks = None if found is None else below(footer, found)
    for i in range(0 if blocks is None else value(footer, "I", blocks)):
        start, head = struct.unpack_from("<qi", footer, blocks + 4 + 24 * i)
        message = at(start, head)
        # older files have no mark before a message's length
        message = message[8 if message[:4] == b"\xff" * 4 else 4 :]
        batch = below(message, field(message, below(message, 0), 2))
        rows = field(message, batch, 0)
        out.append(0 if rows is None else value(message, "q", rows))
    return out


class _Batch(InputPartition):
    def __init__(self, path: str, order: int, number: int, first: int, error: str | None = None):
        self.path, self.order, self.number, self.first, self.error = path, order, number, first, error


class _Reader(DataSourceReader):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files

    def partitions(self) -> list[_Batch]:
        out = []
        for order, path in self.files:
            try:
                with storage.open_file(path) as source:
                    ipc.open_file(source)
                    first = 0
                    for n, rows in enumerate(batch_rows(source)):
                        out.append(_Batch(path, order, n, first))
                        first += rows
            except (OSError, pa.ArrowException, struct.error, TypeError) as error:
                out = [b for b in out if b.path != path] + [_Batch(path, order, -1, 0, str(error))]
        return out

    def read(self, partition: _Batch) -> Iterator[tuple]:
        if partition.error is not None:
            yield file_error(partition.path, partition.order, ValueError(partition.error))
            return
        try:
            with storage.open_file(partition.path) as source:
                rows = ipc.open_file(source).get_batch(partition.number).to_pylist()
        except (OSError, pa.ArrowException, ValueError) as error:  # what only the batch's own bytes show
            yield file_error(partition.path, partition.order, error)
            return
        for i, row in enumerate(rows):
            yield (partition.path, partition.order, partition.first + i, None, *records.describe(row))


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return records.RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader([(int(o), p) for o, p in (x.split(" ", 1) for x in self.options["files"].split("\n"))])


def read_arrow(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    return spark.read.format(FORMAT).option("files", "\n".join(f"{i} {p}" for i, p in files)).load()
