"""ZIP archives of documents and catalogue lines.

Listing reads only central directories. Reading spreads members, not archives, over tasks,
so one large archive is read by many tasks at once. A broken archive or member becomes a row
with an ``error``; the run goes on.
"""

from __future__ import annotations

import math
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.session import parallelism

ZIP_GLOB = "*.[zZ][iI][pP]"

MEMBER_SCHEMA = "path string, archive string, member string, size long, error string"
LINE_BATCH = 10_000
# Members one task reads: some GB of books.
MEMBERS_PER_TASK = 2_000
# Bytes of members handed to Spark at a time; one larger member forms its own batch.
BATCH_BYTES = 4 << 20
# Bytes of texts of a batch that are handled at a time.
PIECE_BYTES = 1 << 20


def list_members(spark: SparkSession, location: str, glob: str | None = ZIP_GLOB) -> DataFrame:
    """One row per non-directory member of every archive under ``location``.

    ``location`` is a folder (archives chosen by ``glob``) or one file (``glob=None``).
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return members_of(reader.load(location).select("path"))


def members_of(paths: DataFrame) -> DataFrame:
    """One row per non-directory member of every archive in ``path``."""
    paths = paths.select("path").repartition(parallelism(paths.sparkSession), "path")
    return paths.mapInPandas(_list, MEMBER_SCHEMA)


def read_members(members: DataFrame) -> DataFrame:
    """Bytes of every listed member: the listing's columns plus ``content``, ``error``.

    ``members`` needs ``path`` and ``member``; other columns come along. It is looked at more
    than once before the reading starts, so write a long listing to a table first.
    """
    return map_members(
        members,
        lambda content, error: {"content": content, "error": error},
        "content binary, error string",
    )


def map_members(
    members: DataFrame, handle: Callable[[bytes | None, str | None], dict], fields: str
) -> DataFrame:
    """What ``handle`` makes of each member's bytes (or of the error), as columns ``fields``.

    The bytes are handled in the task that reads them, so they are not shipped.
    """
    carried = [f for f in members.schema.fields if f.name not in ("content", "error")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for row, archive, error in _archives(batches):
            content = None
            if archive is not None:
                try:
                    content = archive.read(row.member)
                except Exception as failure:
                    error = repr(failure)
            rows.append({**row._asdict(), **handle(content, error)})
            held += len(content or b"")
            if held >= BATCH_BYTES or len(rows) >= LINE_BATCH:
                yield pd.DataFrame(rows)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows)

    placed = _by_member(members.select([f.name for f in carried]))
    return placed.mapInPandas(run, f"{schema}, {fields}")


def read_lines(members: DataFrame) -> DataFrame:
    """Text lines of every listed member, streamed: ``archive, member, line, error``."""
    return _by_member(members.select("path", "archive", "member")).mapInPandas(
        _lines, "archive string, member string, line string, error string"
    )


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of a column: what is made of a slice need not be held for the whole batch."""
    held = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    of = np.cumsum(held, dtype=np.int64) // most
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist() if len(of) else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows (without the ``error`` column) and rejected rows."""
    return rows.where(F.col("error").isNull()).drop("error"), rows.where(F.col("error").isNotNull())


def _by_member(members: DataFrame) -> DataFrame:
    # A range over (path, member) gives even tasks whatever the archives' sizes, and keeps
    # the members of an archive together. The number is explicit: rows are small here, the
    # work behind them is not, so the partitions must not be merged by their size; and a
    # task that is lost should not take hours of work with it.
    n = max(parallelism(members.sparkSession), math.ceil(members.count() / MEMBERS_PER_TASK))
    return members.repartitionByRange(n, "path", "member").sortWithinPartitions("path", "member")


class _Handle:
    """A file whose impossible positions are OSErrors: zipfile tries them on archives with nothing in them."""

    def __init__(self, raw):
        self.raw = raw

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self.raw.seek(at, whence)
        except pa.ArrowInvalid as failure:
            raise OSError(str(failure)) from failure

    def __getattr__(self, name: str):
        return getattr(self.raw, name)


@contextmanager
def open_archive(path: str) -> Iterator[zipfile.ZipFile]:
    """Archive by local path or URI (any filesystem pyarrow reads), on the executor."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(inner) as raw, zipfile.ZipFile(_Handle(raw)) as archive:
        yield archive


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "archive", "member", "size", "error"]
    for batch in batches:
        for path in batch["path"]:
            name = path.rsplit("/", 1)[-1]
            try:
                with open_archive(path) as archive:
                    found = [i for i in archive.infolist() if not i.is_dir()]
                rows = [(path, name, i.filename, i.file_size, None) for i in found]
            except Exception as error:  # a broken archive is a rejected row
                rows = [(path, name, None, None, repr(error))]
            for at in range(0, len(rows), LINE_BATCH):
                yield pd.DataFrame(rows[at : at + LINE_BATCH], columns=columns)


def _archives(batches: Iterator[pd.DataFrame]):
    """(row, open archive or None, error) for rows sorted by path; each archive opens once."""
    path, handle, archive, error = None, None, None, None
    try:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.path != path:
                    if archive is not None:
                        handle.__exit__(None, None, None)
                    path, archive, error = row.path, None, None
                    try:
                        handle = open_archive(path)
                        archive = handle.__enter__()
                    except Exception as failure:
                        archive, error = None, repr(failure)
                yield row, archive, error
    finally:
        if archive is not None:
            handle.__exit__(None, None, None)


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive", "member", "line", "error"]
    for row, archive, error in _archives(batches):
        rows = []
        try:
            if archive is None:
                raise OSError(error)
            with archive.open(row.member) as text:
                for piece in text:  # up to the next \n; splitlines knows the other line ends
                    try:
                        for line in piece.decode("utf-8").splitlines():
                            rows.append((row.archive, row.member, line, None))
                    except UnicodeDecodeError as failure:  # the line is rejected, the rest is read
                        rows.append((row.archive, row.member, None, repr(failure)))
                    if len(rows) >= LINE_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        except Exception as failure:
            rows.append((row.archive, row.member, None, error or repr(failure)))
        if rows:
            yield pd.DataFrame(rows, columns=columns)
