"""ZIP archives as a format of Spark: ``spark.read.format("book_archives")``, and the same for streams.

A task is given a range of bytes of an archive and takes the members that begin there, so plans are
made from sizes of files alone and one huge archive is many tasks. Options:

* the path, a folder or one archive; ``glob``: names of archives in the folder;
* ``content``: ``false`` lists the members, else their bytes are read;
* ``splitBytes``: bytes of archives for a task; ``minPartitions``: tasks to aim for where there is less;
* ``log`` (streams): a folder in which the stream writes down what arrived in which batch.

A broken archive or member is a row with an ``error``. An empty archive has no rows. Members of one name are
rows of their own.
"""

from __future__ import annotations

import fnmatch
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from kindred.session import parallelism
from kindred.sources.archives import BATCH_BYTES, LINE_BATCH, ZIP_GLOB, open_archive

NAME = "book_archives"
LISTED = "path string, archive string, member string, size long, error string"
READ = "path string, archive string, member string, size long, content binary, error string"
SPLIT_BYTES = 64 << 20
# What a cell of an Arrow batch can hold.
MOST_BYTES = (1 << 31) - 1


def archives_under(spark: SparkSession, location: str, content: bool = True, glob: str = ZIP_GLOB) -> DataFrame:
    """Members of the archives under ``location``: ``path, archive, member, size``, ``content`` if asked, ``error``."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format(NAME).option("content", str(content).lower()).option("glob", glob)
    return reader.option("minPartitions", parallelism(spark)).load(location)


def archive_arrivals(spark: SparkSession, location: str, log: str, content: bool = False) -> DataFrame:
    """The same of archives as they arrive in a folder, whatever their times say. A stream has a ``log`` of its own.

    An archive must be whole when it appears under its name, as with any stream of files."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.readStream.format(NAME).option("content", str(content).lower()).option("log", log)
    return reader.option("minPartitions", parallelism(spark)).load(location)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ if _content(self.options) else LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Arrivals(dict(self.options))


@dataclass
class _Split(InputPartition):
    """(path, first byte, end) of each piece of an archive that a task reads."""

    pieces: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_Split]:
        return _splits(_files(self.options), self.options) or [_Split([])]  # Spark wants a task

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        return _read(partition, _content(self.options))


class _Arrivals(DataSourceStreamReader):
    """Offsets are numbers of files of the log; such a file names the archives that came with it."""

    def __init__(self, options: dict[str, str]):
        if "log" not in options:
            raise ValueError("a stream of archives needs the option log")
        self.options, self.last, self.seen = options, None, set()

    def __getstate__(self) -> dict:
        return {"options": self.options, "last": None, "seen": set()}  # tasks need no log

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        store, log = _place(self.options["log"])
        if self.last is None:
            store.create_dir(log, recursive=True)
            names = [i.base_name for i in store.get_file_info(fs.FileSelector(log))]
            self.last = max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)
            for n in range(1, self.last + 1):
                self.seen.update(path for path, _ in self._logged(n))
        new = [f for f in _files(self.options) if f[0] not in self.seen]
        if new:
            # A file of the log is whole or absent.
            name = f"{log}/{self.last + 1:09d}"
            with store.open_output_stream(f"{name}.part") as out:
                out.write(json.dumps(new).encode())
            store.move(f"{name}.part", f"{name}.json")
            self.last += 1
            self.seen.update(path for path, _ in new)
        return {"batch": self.last}

    def _logged(self, n: int) -> list[tuple[str, int]]:
        store, log = _place(self.options["log"])
        with store.open_input_stream(f"{log}/{n:09d}.json") as held:
            return [tuple(f) for f in json.loads(held.read())]

    def partitions(self, start: dict, end: dict) -> list[_Split]:
        files = [f for n in range(start["batch"] + 1, end["batch"] + 1) for f in self._logged(n)]
        return _splits(files, self.options)

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        return _read(partition, _content(self.options))

    def commit(self, end: dict) -> None:
        pass


def _content(options) -> bool:
    return str(options.get("content", "true")).lower() != "false"


def _place(location: str) -> tuple[fs.FileSystem, str]:
    if location.startswith("file:"):
        location = "/" + location[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(location) if "://" in location else (fs.LocalFileSystem(), location.rstrip("/"))


def _files(options: dict[str, str]) -> list[tuple[str, int]]:
    """(path, size) of the archives, by path."""
    location, glob = options["path"], options.get("glob", ZIP_GLOB)
    store, inner = _place(location)
    given = store.get_file_info(inner)
    if given.type == fs.FileType.NotFound:
        raise FileNotFoundError(location)
    if given.type == fs.FileType.File:
        return [(location, given.size)]
    found = [i for i in store.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, glob)]
    return sorted((f"{location.rstrip('/')}/{i.base_name}", i.size) for i in found)


def _splits(files: list[tuple[str, int]], options: dict[str, str]) -> list[_Split]:
    """Large archives are cut, small ones share a task. An archive that is only listed is one piece."""
    total = sum(size for _, size in files)
    most = min(int(options.get("splitBytes", SPLIT_BYTES)), -(-total // int(options.get("minPartitions", 1))))
    most, whole = max(most, 1), not _content(options)
    made, held, own = [], [], 0
    for path, size in files:
        step = max(size, 1) if whole else most
        for at in range(0, max(size, 1), step):
            end = min(at + step, size)
            if held and own + end - at > most:
                made.append(_Split(held))
                held, own = [], 0
            held.append((path, at, end))
            own += end - at
    return [*made, _Split(held)] if held else made


def _read(split: _Split, content: bool) -> Iterator[pa.RecordBatch]:
    fields = [("path", pa.string()), ("archive", pa.string()), ("member", pa.string()), ("size", pa.int64())]
    schema = pa.schema([*fields, *([("content", pa.binary())] if content else []), ("error", pa.string())])
    rows, held = [], 0
    for row in _rows(split, content):
        rows.append(row)
        held += len(row.get("content") or b"")
        if held >= BATCH_BYTES or len(rows) >= LINE_BATCH:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _rows(split: _Split, content: bool) -> Iterator[dict]:
    for path, first, end in split.pieces:
        own = {"path": path, "archive": path.rsplit("/", 1)[-1]}
        try:
            with open_archive(path) as archive:
                for info in archive.infolist():
                    if info.is_dir() or not first <= info.header_offset < end:
                        continue
                    yield {**own, "member": info.filename, "size": info.file_size, **(_content_of(archive, info) if content else {})}
        except OSError as failure:
            yield {**own, "error": repr(failure)}
        except Exception as failure:
            if first == 0:  # no archive, for any task; told once
                yield {**own, "error": repr(failure)}


def _content_of(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> dict:
    if info.file_size > MOST_BYTES:
        return {"error": f"{info.file_size} bytes are more than a row holds"}
    try:
        return {"content": archive.read(info)}
    except Exception as failure:  # a broken member is a rejected row
        return {"error": repr(failure)}
