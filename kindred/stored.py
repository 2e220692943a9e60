"""Files of staged tables that tasks read themselves, wherever they run: what many tasks need is not shuffled to each."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame

from kindred.session import work_path


def opened(name: str) -> tuple[fs.FileSystem, str]:
    if name.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + name[len("file:") :].lstrip("/"))
    return fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)


def readable(name: str) -> bool:
    """Whether a file or folder lies in a store that tasks can open without Spark."""
    try:
        store, path = opened(name)
        return store.get_file_info(path).type != fs.FileType.NotFound
    except (pa.ArrowException, OSError, ValueError):
        return False


def under(folder: str) -> list[str]:
    """Files of a folder that Spark wrote, in order; none if it wrote no such folder."""
    store, path = opened(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))


def batches(name: str, columns: list[str] | None = None, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The rows of one file, some at a time."""
    store, path = opened(name)
    with store.open_input_file(path) as raw:
        yield from pq.ParquetFile(raw, buffer_size=1 << 20).iter_batches(rows, columns=columns, use_threads=False)


def written(table: DataFrame, name: str, *by: str, most: int | None = None) -> str:
    """A staged table as a folder: split by columns, or with at most so many rows in a file."""
    path = work_path(table.sparkSession, name)
    out = table.write.partitionBy(*by) if by else table.write
    (out.option("maxRecordsPerFile", most) if most else out).parquet(path)
    return path
