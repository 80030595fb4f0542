"""Compressed text as a stream of lines: a Python data source with one partition per file.

A file is inflated piece by piece while its lines are handed on, so neither a file nor what it
unpacks to has to fit anywhere.  Reading ends at a line that is too long, or after a number of lines.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from itemloom.model import MAX_LINE_BYTES, require
from itemloom.runtime import share_package

COMPRESSIONS = (None, "zip", "gzip", "bzip2")
READ, WRITE, JOIN = "itemloom_lines", "itemloom_zip", "itemloom_joined"
_SCHEMA = "file string, number long, line string"
_BATCH_ROWS, _BATCH_CHARS = 10_000, 1 << 22
_COPY_BYTES = 1 << 20


def stream_lines(
    spark: SparkSession,
    files: Sequence[str],
    compression: str | None = None,
    encoding: str = "UTF-8",
    max_line_bytes: int = MAX_LINE_BYTES,
    lines: int | None = None,
) -> DataFrame:
    """``file, number, line`` of each file, numbered from 1; at most ``lines`` of a file.

    Of a zip the first entry is read.  A line of more than ``max_line_bytes`` bytes of UTF-8 fails the job
    without being read to its end.  Lines of a file stay in order within one partition.
    """
    require(compression in COMPRESSIONS, f"unknown compression {compression}")
    require(max_line_bytes > 0 and (lines is None or lines > 0), "limits have to be positive")
    share_package(spark)
    spark.dataSource.register(LineStreams)
    options = {"compression": compression or "", "encoding": encoding, "maxLineBytes": max_line_bytes, "lines": lines or 0}
    return spark.read.format(READ).options(**options).option("files", json.dumps(list(files))).load()


def write_zip(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Write a table of one text column as zip files, one entry per partition, each with the header."""
    share_package(lines.sparkSession)
    lines.sparkSession.dataSource.register(ZipFiles)
    writer = lines.toDF("line").write.format(WRITE).mode("append").option("path", path)
    (writer if header is None else writer.option("header", header)).save()


def write_joined(lines: DataFrame, folder: str, file: str, head: str = "", tail: str = "") -> str:
    """Write a table of one text column as one file: head, the partitions in their order, tail.

    Tasks write their parts side by side and the commit puts them together; gives the file's path.
    """
    share_package(lines.sparkSession)
    lines.sparkSession.dataSource.register(JoinedText)
    options = {"path": folder, "file": file, "head": head, "tail": tail}
    lines.toDF("line").write.format(JOIN).mode("append").options(**options).save()
    return f"{folder.rstrip('/')}/{file}"


def open_file(uri: str):
    """A file of any store pyarrow knows by its scheme; a path without one is local."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def inflated(file, compression: str | None) -> io.BufferedIOBase:
    """The content of an open file as a stream that inflates as it is read."""
    if compression == "gzip":
        return gzip.GzipFile(fileobj=file)
    if compression == "bzip2":
        return bz2.BZ2File(file)
    if compression == "zip":
        try:
            archive = zipfile.ZipFile(file)
        except pa.ArrowInvalid as error:  # it looked for the directory before the start of the file
            raise ValueError("too short for an archive with entries") from error
        require(bool(archive.namelist()), "an archive without entries")
        return archive.open(archive.namelist()[0])
    return io.BufferedReader(file)


def bounded_lines(stream: io.BufferedIOBase, encoding: str, most: int) -> Iterator[str]:
    """Lines without their ends; at most ``most`` characters of a line are ever held."""
    text = io.TextIOWrapper(stream, encoding=encoding, newline=None)
    while line := text.readline(most + 1):
        line = line.removesuffix("\n")
        # characters are counted first: that bounds what is held and encoded
        if len(line) > most or len(line.encode("utf-8", "surrogatepass")) > most:
            raise ValueError(f"a line is longer than {most} bytes")
        yield line


@dataclass
class OneFile(InputPartition):
    uri: str


class LineStreams(DataSource):
    @classmethod
    def name(cls) -> str:
        return READ

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.compression, self.encoding = options["compression"] or None, options["encoding"]
        self.most, self.lines = int(options["maxLineBytes"]), int(options["lines"])

    def partitions(self) -> list[OneFile]:
        return [OneFile(uri) for uri in self.files]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with open_file(partition.uri) as file, inflated(file, self.compression) as stream:
            block: list[str] = []
            chars = done = 0
            for line in bounded_lines(stream, self.encoding, self.most):
                block.append(line)
                chars += len(line)
                full = len(block) == _BATCH_ROWS or chars >= _BATCH_CHARS
                if full or done + len(block) == self.lines:
                    yield self._batch(partition.uri, done, block)
                    done, block, chars = done + len(block), [], 0
                    if done == self.lines:
                        return
            if block:
                yield self._batch(partition.uri, done, block)

    @staticmethod
    def _batch(uri: str, done: int, block: list[str]) -> pa.RecordBatch:
        numbers = pa.array(range(done + 1, done + 1 + len(block)), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([uri] * len(block)), numbers, pa.array(block)], ["file", "number", "line"])


class ZipFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return WRITE

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ZipWriter(self.options)


class JoinedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return JOIN

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return JoinedWriter(self.options)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str


class PartWriter(DataSourceWriter):
    """Tasks write below ``_temporary``; only what was committed is used, so repeated tasks do no harm."""

    def __init__(self, options):
        self.path, self.options, self.run = options["path"].rstrip("/"), dict(options), uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def _pending(self, folder: str, name: str) -> str:
        return posixpath.join(folder, "_temporary", self.run, name)

    def write(self, rows) -> Written:
        store, folder = self._store()
        name = f"part-{uuid.uuid4().hex}{self.suffix}"
        store.create_dir(posixpath.dirname(self._pending(folder, name)), recursive=True)
        with store.open_output_stream(self._pending(folder, name)) as file:
            self.fill(file, (line for (line,) in rows))
        return Written(TaskContext.get().partitionId(), name)

    def commit(self, messages) -> None:
        store, folder = self._store()
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        self.finish(store, folder, [m.name for m in done])

    def abort(self, messages) -> None:
        """What was not committed stays below ``_temporary``, where nobody reads."""


class ZipWriter(PartWriter):
    suffix = ".zip"

    def fill(self, file, lines: Iterator[str]) -> None:
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive, archive.open("part.txt", "w", force_zip64=True) as entry:
            if self.options.get("header") is not None:
                entry.write(f"{self.options['header']}\n".encode())
            for line in lines:
                entry.write(f"{line}\n".encode())

    def finish(self, store: fs.FileSystem, folder: str, names: list[str]) -> None:
        for name in names:
            store.move(self._pending(folder, name), posixpath.join(folder, name))


class JoinedWriter(PartWriter):
    """The parts of all partitions in their order as one file, streamed piece by piece."""

    suffix = ".txt"

    def fill(self, file, lines: Iterator[str]) -> None:
        for line in lines:
            file.write(f"{line}\n".encode())

    def finish(self, store: fs.FileSystem, folder: str, names: list[str]) -> None:
        whole = self._pending(folder, self.options["file"])
        store.create_dir(posixpath.dirname(whole), recursive=True)
        with store.open_output_stream(whole) as out:
            out.write(self.options["head"].encode())
            for name in names:
                with store.open_input_stream(self._pending(folder, name)) as part:
                    while piece := part.read(_COPY_BYTES):
                        out.write(piece)
            out.write(self.options["tail"].encode())
        # it appears under its name only when it is whole
        store.move(whole, posixpath.join(folder, self.options["file"]))
