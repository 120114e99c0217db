"""Framed record streams: ``<label or key> <length>\\n<length bytes>``, repeated.

A stream ends at the first record that does not parse or is not whole, and a record has at least one byte.
Registered as the data sources ``framed_labels`` and ``framed_keys``, to read (a file a partition), to
read as a stream (files that grow, or are added, by offsets) and, by keys, to write.  ``read_framed``
splits files.  Paths are local or of a store that pyarrow opens (hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a stretch that one task reads, of a head at most, and of a batch of records.
STRETCH, _HEAD_MOST, _BATCH = 128 << 20, 1 << 16, 8 << 20

_HEAD = re.compile(rb"(\S+) (\d+)\n")


def records(stream: BinaryIO) -> Iterator[tuple[bytes, bytes]]:
    """(head, body) of each record."""
    while m := _HEAD.fullmatch(stream.readline(_HEAD_MOST)):
        n = int(m[2])
        body = stream.read(n)
        if not n or len(body) < n:
            return
        yield m[1], body


def _parsed(head: bytes, labels: bool) -> float | str | None:
    """A record's label or key; none ends the stream."""
    try:
        return float(head) if labels else head.decode()
    except ValueError:
        return None


def named(stream: BinaryIO, labels: bool) -> Iterator[tuple[float | str, bytes]]:
    for head, body in records(stream):
        if (name := _parsed(head, labels)) is None:
            return
        yield name, body


def labelled(stream: BinaryIO) -> Iterator[tuple[float, bytes]]:
    return named(stream, True)


def frame(head: str | float, body: bytes) -> bytes:
    name = f"{head:g}" if isinstance(head, float) else head
    return f"{name} {len(body)}\n".encode() + body


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and its name there."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of a folder's files or of those of a pattern, in order; those being written are not seen."""
    store, name = located(path)
    prefix = path[: len(path) - len(name)]
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    folder, pattern = (name, "*") if info.type == fs.FileType.Directory else posixpath.split(name)
    found = store.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    files = [(prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatchcase(x.base_name, pattern) and x.base_name[0] not in "_."]
    if not files and info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    return sorted(files)


def stretches(path: str, start: int, end: int, labels: bool, size: int = STRETCH) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of whole records, about ``size`` bytes each, between two places of a file.

    Reads heads, and what stands within 64 KiB behind them; bodies beyond are skipped.
    """
    store, name = located(path)
    with store.open_input_file(name) as file:
        began = at = base = start
        block = b""
        while at < end:
            cut = block.find(b"\n", at - base) if at < base + len(block) else -1
            if cut < 0:
                base, block = at, file.read_at(min(_HEAD_MOST, end - at), at)
                cut = block.find(b"\n")
            head = _HEAD.fullmatch(block, at - base, cut + 1) if cut >= 0 else None
            if head is None or not (length := int(head[2])) or base + head.end() + length > end or _parsed(head[1], labels) is None:
                break
            at = base + head.end() + length
            if at - began >= size:
                yield began, at
                began = at
        if at > began:
            yield began, at


def read_stretch(path: str, start: int, stop: int, labels: bool) -> Iterator[tuple[float | str, bytes]]:
    """The records of a run."""
    store, name = located(path)
    with store.open_input_file(name) as file:
        file.seek(start)
        at = start
        for head, body in records(io.BufferedReader(file, 1 << 20)) if start < stop else ():
            yield _parsed(head, labels), body
            at += len(head) + len(f" {len(body)}\n") + len(body)
            if at >= stop:
                return


@dataclass
class _Stretch(InputPartition):
    path: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, labels: bool):
        self.path, self.labels = path, labels

    def partitions(self) -> list[InputPartition]:
        return [_Stretch(path, 0, size) for path, size in listed(self.path)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        store, name = located(partition.path)
        with store.open_input_stream(name) as file:
            yield from named(io.BufferedReader(file, 1 << 20), self.labels)


class _StreamReader(DataSourceStreamReader):
    """Offsets are where each file's last whole record ends; files grow at their ends or are added.

    The driver reads the heads of what is new.  A file whose end does not parse is waited for.
    """

    def __init__(self, path: str, labels: bool, size: int):
        self.path, self.labels, self.size = path, labels, size
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in listed(self.path):
            at = self.known.get(path, 0)
            for _, at in stretches(path, at, size, self.labels, self.size):
                pass
            self.known[path] = at
        return {path: at for path, at in self.known.items() if at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = {path: max(at, self.known.get(path, 0)) for path, at in end.items()}
        return [_Stretch(path, *run) for path, stop in sorted(end.items()) for run in stretches(path, start.get(path, 0), stop, self.labels, self.size)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        return read_stretch(partition.path, partition.start, partition.stop, self.labels)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Wrote(WriterCommitMessage):
    names: tuple[str, ...]


class _Writer(DataSourceWriter):
    """A file a task, hidden until all tasks are done; rows without a body, which no stream can hold, are an error."""

    def __init__(self, path: str, overwrite: bool):
        if overwrite:
            raise ValueError("framed files are only added")
        self.path = path

    def write(self, iterator: Iterator) -> _Wrote:
        store, folder = located(self.path)
        store.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.framed"
        with store.open_output_stream(f"{folder}/_{name}") as out:
            for key, content in iterator:
                if not content or key is None or not re.fullmatch(r"\S+", str(key)):
                    raise ValueError(f"no framed record: key {key!r}, {len(content or b'')} bytes")
                out.write(frame(str(key), bytes(content)))
        return _Wrote((name,))

    def commit(self, messages: list[_Wrote]) -> None:
        store, folder = located(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[_Wrote]) -> None:
        store, folder = located(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{folder}/_{name}")


class _Framed(DataSource):
    labels: bool

    @classmethod
    def name(cls) -> str:
        return "framed_labels" if cls.labels else "framed_keys"

    def schema(self) -> str:
        return f"{'label float' if self.labels else 'key string'}, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.labels)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self.labels, int(self.options.get("stretch", STRETCH)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if self.labels:
            raise NotImplementedError("labels are written by framed_keys, as strings")
        return _Writer(self.options["path"], overwrite)


class FramedLabels(_Framed):
    labels = True


class FramedKeys(_Framed):
    labels = False


def read_framed(spark: SparkSession, path: str, labels: bool = True, stretch: int = STRETCH) -> DataFrame:
    """(label or key, content) of a file, folder or pattern, files split at records into runs of about ``stretch`` bytes.

    A first job, a task a file, reads the heads; the runs are then dealt over as many tasks as there may be.
    Null or empty files give no rows; a missing path is an error.
    """
    name, kind = ("label", "float") if labels else ("key", "string")
    schema = pa.schema([(name, pa.float32() if labels else pa.string()), ("content", pa.binary())])
    files = listed(path)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, a, b) for p, size in zip(*(c.to_pylist() for c in batch.columns)) for a, b in stretches(p, 0, size, labels, stretch)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ((),) * 3, (pa.string(), pa.int64(), pa.int64()))], ["path", "start", "stop"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                for record in read_stretch(*run, labels):
                    held.append(record)
                    size += len(record[1])
                    if size >= _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    tasks = max(1, -(-sum(size for _, size in files) // stretch))
    named_files = spark.createDataFrame(files, "path string, size long").repartition(max(1, min(len(files), 10_000)), "path")
    found = named_files.mapInArrow(runs, "path string, start long, stop long")
    return found.repartition(tasks).mapInArrow(rows, f"{name} {kind}, content binary")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramedLabels)
    spark.dataSource.register(FramedKeys)


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, content): one row a file of any store that Spark reads; a missing path is an error."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("key"), "content")


def one_document(spark: SparkSession, content: bytes, name: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(name, bytearray(content))], "key string, content binary")


def from_bytes(spark: SparkSession, stream: bytes, labels: bool = True) -> DataFrame:
    rows = named(io.BytesIO(stream), labels)
    return spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "label float, content binary" if labels else "key string, content binary")


def write_scores(scores: DataFrame, path: str) -> None:
    """Tab-separated name and score; the order of rows is not fixed."""
    scores.select(F.concat_ws("\t", F.col(scores.columns[0]).cast("string"), F.format_string("%.9g", F.col(scores.columns[1])))).write.mode("overwrite").text(path)
