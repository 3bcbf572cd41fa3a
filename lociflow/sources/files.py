"""Files at any address that the file-system library knows (a path that all executors mount, file://, hdfs://, s3://,
gs://, abfs://): ranges of bytes for readers, and a sink that joins tasks' parts to one file."""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that a reader fetches ahead, and that a commit copies at once.
AHEAD, COPIED = 1 << 20, 1 << 23


def located(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path there of an address."""
    if re.match(r"[a-z][a-z0-9+.-]*:", address):
        return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", address))
    return fs.LocalFileSystem(), os.path.abspath(address)


def exists(address: str) -> bool:
    system, path = located(address)
    return system.get_file_info(path).type == fs.FileType.File


class Ranges:
    """Ranges of bytes of a file, for `with`."""

    def __init__(self, address: str):
        system, path = located(address)
        self.file = system.open_input_file(path)

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def size(self) -> int:
        return self.file.size()

    def get(self, offset: int, length: int) -> bytes:
        found = self.file.read_at(length, offset) if length else b""
        if len(found) != length:
            raise ValueError(f"the file ends before byte {offset + length}")
        return found

    def stream(self, offset: int = 0) -> io.BufferedReader:
        """Reads on from an offset, AHEAD bytes at a time."""
        self.file.seek(offset)
        return io.BufferedReader(self.file, AHEAD)


@dataclass
class Part(WriterCommitMessage):
    number: int
    paths: list[str]


class JoinedSink(DataSource):
    """format("lociflow_joined"): writes rows of binary columns, the bytes of each column one after the other, to one file
    a column. Options: path.COLUMN, and head.COLUMN, bytes in hex that come first.

    Tasks write parts beside the first file; the commit joins them by the tasks' numbers and takes them away, so that
    sorted rows make files in their order, a task may be run again, and what a failed run leaves is no file of its name."""

    @classmethod
    def name(cls) -> str:
        return "lociflow_joined"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return JoinedWriter([(c, self.options[f"path.{c}"], bytes.fromhex(self.options.get(f"head.{c}", ""))) for c in schema.names])


class JoinedWriter(DataSourceArrowWriter):
    def __init__(self, files: list[tuple[str, str, bytes]]):
        self.files = files
        self.folder = f"{files[0][1]}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, folder = located(self.folder)
        system.create_dir(folder, recursive=True)
        number, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        paths = [f"{folder}/{number}-{attempt}-{k}" for k in range(len(self.files))]
        streams = [system.open_output_stream(p) for p in paths]
        for batch in iterator:
            for k, (column, _, _) in enumerate(self.files):
                for piece in batch.column(column):
                    streams[k].write(piece.as_buffer())
        for s in streams:
            s.close()
        return Part(number, paths)

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = located(self.folder)
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        for k, (_, address, head) in enumerate(self.files):
            to, path = located(address)
            with to.open_output_stream(path) as out:
                out.write(head)
                for part in parts:
                    with system.open_input_stream(part.paths[k]) as piece:
                        while chunk := piece.read(COPIED):
                            out.write(chunk)
        if parts:
            system.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = located(self.folder)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def write_joined(rows: DataFrame, **files: tuple[str, bytes]) -> None:
    """Write sorted rows of binary columns, named as in files: (address, first bytes) each."""
    rows.sparkSession.dataSource.register(JoinedSink)
    options = {f"path.{c}": address for c, (address, _) in files.items()} | {f"head.{c}": head.hex() for c, (_, head) in files.items()}
    rows.select(*files).write.format("lociflow_joined").options(**options).mode("append").save()
