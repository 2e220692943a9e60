"""New archives or catalogue lines as a stream of books to add to the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from kindred import schemas
from kindred.plans.ingest import Library, changes, read_books, with_ids
from kindred.session import query_id, stage, union
from kindred.sources.archive_format import archive_arrivals
from kindred.sources.archives import ZIP_GLOB, members_of
from kindred.sources.catalogue import (
    LANGUAGE,
    catalogue_books,
    eligible,
    listed_books,
    parse_lines,
    unseen,
)
from kindred.sources.store import State, Store, Table
from kindred.sources.tables import BOOK_KEY, mark_of

REJECTED = StructType([StructField(n, StringType()) for n in ("archive", "book", "error")])
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


TABLES = {
    "books": Table(schemas.BOOKS, tuple(BOOK_KEY)),
    "embeddings": Table(schemas.EMBEDDINGS, ("book_id",)),
    "authors": Table(schemas.AUTHORS, ("id",)),
    "book_authors": Table(schemas.BOOK_AUTHORS, ("book_id",)),
    "rejected": Table(REJECTED),
}


class LibraryStore:
    """The four library tables and rejected books under one path; a batch changes all of them or none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.store = Store(spark, path, TABLES)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def read(self, state: State | None = None) -> Library:
        state = state or self.store.state()
        return Library(*[self.store.read(name, state) for name in list(TABLES)[:4]])

    def add(
        self,
        found: DataFrame,
        folder: str,
        encoder: Callable[[DataFrame], DataFrame],
        token: str,
        unlisted: DataFrame | None = None,
    ) -> None:
        """Read the found books that are new and add them; the same token twice adds once.

        Documents that cannot be read go to ``rejected``, and so do ``unlisted`` archives. Ids are
        numbered after those of the state the batch started from: should another writer have changed
        the library meanwhile, ``Conflict`` is raised, and the batch can be run again.
        """
        state, mark = self.store.state(), mark_of(token)
        if self.store.applied(*mark, state):
            return
        # The archives are read once, into the shared folder; all tables are made from that.
        library = self.read(state)
        new = stage(unseen(found, library.books), "found")
        numbered = stage(with_ids(new, library.books), "numbered")
        read = stage(read_books(numbered, folder), "read")
        good, bad = read.where("error IS NULL").drop("error"), read.where("error IS NOT NULL")
        bad = bad.select(REJECTED.names)
        new = changes(library, good, encoder)
        rows = {
            "books": new.books,
            "embeddings": new.embeddings,
            "authors": new.authors,
            "book_authors": new.book_authors,
            "rejected": bad if unlisted is None else union(bad, unlisted),
        }
        self.store.commit(rows, mark=mark, based_on=state.version)
        for name in TABLES:
            self.store.compact(name)


def archive_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of archives as they arrive in a folder."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    return reader.option("pathGlobFilter", ZIP_GLOB).load(folder).select("path")


def member_stream(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """Members of archives as the archives arrive in a folder, listed by the tasks of the stream itself."""
    return archive_arrivals(spark, folder, log)


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of unpacked catalogue members as they arrive in a folder."""
    return spark.readStream.text(folder).select(
        F.col("_metadata.file_name").alias("member"), F.col("value").alias("line")
    )


Found = tuple[DataFrame, DataFrame | None]


def books_of_archives(paths: DataFrame) -> Found:
    """Books in the archives, and the archives that cannot be listed."""
    return books_of_members(members_of(paths))


def books_of_members(members: DataFrame) -> Found:
    """Listed members as books, and the archives that cannot be listed."""
    members = stage(members, "listed")
    broken = members.where("error IS NOT NULL")
    return listed_books(members), broken.select("archive", F.col("member").alias("book"), "error")


def books_of_lines(lines: DataFrame, language: str = LANGUAGE) -> Found:
    return catalogue_books(eligible(parse_lines(lines), language)), None


def start(
    stream: DataFrame,
    to_books: Callable[[DataFrame], Found],
    folder: str,
    store: LibraryStore,
    encoder: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Add the books of a stream (``archive_stream``, ``member_stream`` or ``line_stream``) to the library."""

    def take(batch: DataFrame, number: int) -> None:
        found, unlisted = to_books(batch)
        store.add(found, folder, encoder, f"{query_id(batch)}-{number}", unlisted)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
