"""Rows as files of their own, and WAV files as blocks: data sources of Spark.

Files are reached through Arrow's file systems (local, HDFS, S3, GCS and others by their URI), from
the tasks themselves.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import wav

#: Bytes of a WAV file's data that a task decodes at a time, as a default.
BLOCK_BYTES = 8 << 20
#: Bytes of files that are one task's, and what a block counts besides.
PARTITION_BYTES, OPEN_BYTES = 64 << 20, 64
#: Tasks beyond which a folder is dealt to only where each gets ``PARTITION_BYTES``.
MOST_TASKS = 256
#: Rows that a task gives at a time at most, and bytes from which it gives what it has.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 20
#: Where the header of a WAV file must end.
HEAD_BYTES = 1 << 20


def reach(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its folder in the run's, and the names of finished files in it."""

    task: str
    names: list[str]


class FileWriter(DataSourceWriter):
    """Each row (name, content) as a file. Tasks write to a folder of the run; committing moves the files of
    the tasks that count to their names and then writes ``_SUCCESS``, aborting deletes the folder.

    A task that is run again writes files of its own, and only the last one's are moved.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, path = reach(self.path)
        task = uuid.uuid4().hex
        folder = f"{path}/{self.run}/{task}"
        store.create_dir(folder, recursive=True)
        names = []
        for row in rows:
            if not row["name"] or "/" in row["name"] or row["name"].startswith(("_", ".")):
                raise ValueError(f"{row['name']!r} can't be a file's name")
            with store.open_output_stream(f"{folder}/{row['name']}") as out:
                out.write(bytes(row["content"] or b""))
            names.append(row["name"])
        return Written(task, names)

    def commit(self, messages: list[Written]) -> None:
        store, path = reach(self.path)
        written = [m for m in messages if m]
        if len({n for m in written for n in m.names}) < sum(len(m.names) for m in written):
            self.abort(messages)
            raise ValueError("two rows have one name")
        if self.overwrite:
            old = [f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if not f.path.endswith(self.run)]
            for f in old:
                store.delete_dir(f) if store.get_file_info(f).type == fs.FileType.Directory else store.delete_file(f)
        for m in written:
            for name in m.names:
                store.move(f"{path}/{self.run}/{m.task}/{name}", f"{path}/{name}")
        store.create_dir(path, recursive=True)
        if store.get_file_info(f"{path}/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/{self.run}")
        with store.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written]) -> None:
        store, path = reach(self.path)
        if store.get_file_info(f"{path}/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/{self.run}")


class FileRows(DataSource):
    """``df.write.format("file_rows")``: (name string, content binary), a file a row."""

    @classmethod
    def name(cls) -> str:
        return "file_rows"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str) -> None:
    """Rows (name, content) as files in a folder, which is replaced."""
    rows.sparkSession.dataSource.register(FileRows)
    rows.select("name", "content").write.format("file_rows").mode("overwrite").save(path)


def listed(store: fs.FileSystem, path: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder. Local folders are read entry by entry, so that only what is kept is held."""
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        yield info.path, info.size
    elif isinstance(store, fs.LocalFileSystem):
        for entry in os.scandir(path):
            if entry.is_dir():
                yield from listed(store, entry.path)
            elif entry.is_file():
                yield entry.path, entry.stat().st_size
    else:
        yield from ((f.path, f.size) for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File)


@dataclass
class Files(InputPartition):
    """What a task reads: files of a folder by name, and of each the blocks that begin from one byte up to another (None: to the end)."""

    folder: str
    parts: list[tuple[str, int, int | None]]


class WavReader(DataSourceReader):
    def __init__(self, path: str, block_bytes: int, partition_bytes: int):
        self.path, self.block_bytes, self.partition_bytes = path, block_bytes, partition_bytes

    def partitions(self) -> list[Files]:
        """All files in the order of their names, dealt to tasks by bytes, long ones in parts. Only names and lengths are
        known here; a task reads the headers of its files and finds their blocks."""
        store, path = reach(self.path)
        found = [(name, size) for name, size in listed(store, path) if self.asked(name)]
        found.sort(reverse=True)
        base = path.rstrip("/") + "/"
        base = base if all(name.startswith(base) for name, _ in found) else ""
        found = [(name[len(base) :], size) for name, size in found] if base else found
        weigh = lambda size: size + OPEN_BYTES * (1 + size // self.block_bytes)
        total = sum(weigh(size) for _, size in found)
        most = max(self.partition_bytes, min(PARTITION_BYTES, -(-total // MOST_TASKS)))
        dealt, held = [Files(base, [])], 0
        while found:  # what is dealt is held once
            name, size = found.pop()
            for begin in range(0, max(size, 1), most):
                end = begin + most if begin + most < size else None
                weight = weigh((size if end is None else end) - begin)
                if held and held + weight > most:
                    dealt.append(Files(base, []))
                    held = 0
                dealt[-1].parts.append((name, begin, end))
                held += weight
        return dealt

    def asked(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return name.lower().endswith((".wav", ".wave")) and not name.startswith(("_", "."))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = reach(self.path)
        rows, held = [], 0
        for name, begin, end in partition.parts:
            for row in self.blocks(store, partition.folder + name, begin, end):
                rows.append(row)
                held += 0 if row[4] is None else row[4].nbytes
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def blocks(self, store: fs.FileSystem, path: str, begin: int, end: int | None) -> Iterator[tuple]:
        """The rows of a file whose blocks begin in a part of it; what is wrong with a file is said in its first part."""
        with store.open_input_file(path) as content:
            try:
                at, size, (kind, channels, rate, bits) = wav.data_chunk(content.read(HEAD_BYTES))
            except (ValueError, struct.error) as e:
                if begin == 0:
                    yield path, None, None, None, None, str(e)
                return
            width = bits // 8
            size = min(size, content.size() - at) // width * width
            step = max(1, self.block_bytes // (width * channels)) * width * channels
            last = max(size, 1) if end is None else min(max(size, 1), end - at)
            for i in range(max(0, -((at - begin) // step) * step), last, step):
                content.seek(at + i)
                yield path, rate, channels, i // width, wav.samples_of(content.read(min(step, size - i)), kind), None

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.string())
        names = ("path", "sample_rate", "channels", "first", "samples", "error")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


class WavBlocks(DataSource):
    """``spark.read.format("wav_blocks")``: WAV files as blocks of whole frames, read by byte range."""

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return "path string, sample_rate int, channels int, first long, samples array<float>, error string"

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options["path"], int(self.options.get("blockBytes", BLOCK_BYTES)), int(self.options.get("partitionBytes", PARTITION_BYTES)))


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(path, sample_rate, channels, first, samples, error): a row a block of a WAV file; ``first`` numbers its samples.

    A file is cut into ranges of ``block_bytes`` of its data chunk that hold whole frames; each is
    read and decoded by itself, and tasks get ``partition_bytes`` of files (more where there would be
    over ``MOST_TASKS`` of less than the default), so a file of any length is spread and small ones share a task. A file that can't be
    decoded is one row with an error; a cut one gives what it has, one without samples an empty block.
    """
    spark.dataSource.register(WavBlocks)
    return spark.read.format("wav_blocks").option("blockBytes", block_bytes).option("partitionBytes", partition_bytes).load(path)
