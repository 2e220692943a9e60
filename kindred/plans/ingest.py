"""Ingestion: found books -> book, vector and author tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import fallback, fallback_list
from kindred.operators.extract import describe, read_archived
from kindred.sources.markup import BOOK_NAMESPACE
from kindred.sources.tables import (
    BOOK_KEY,
    append,
    author_changes,
    book_ids,
    latest,
    replace_groups,
    save_authors,
    upsert,
)

@dataclass(frozen=True)
class Library:
    books: DataFrame
    embeddings: DataFrame
    authors: DataFrame
    book_authors: DataFrame


def with_ids(found: DataFrame, books: DataFrame) -> DataFrame:
    """One row per found (book, archive), with the ``book_id`` it has or will have.

    Numbers are given before the documents are read: what is numbered is small, and all
    tables can be made from the one table that reading gives. A document that turns out
    unreadable leaves a gap.
    """
    one = latest(found, BOOK_KEY, *[F.col(c) for c in ("title", "author")])
    return book_ids(books, one).withColumnRenamed("id", "book_id")


def read_books(found: DataFrame, folder: str, namespace: str | None = BOOK_NAMESPACE) -> DataFrame:
    """Numbered found books -> their text and metadata; what cannot be read has an ``error``.

    ``found`` has ``book_id, archive, book, title, author, authors`` (null or empty where
    the catalogue does not know); the archives lie in ``folder``.
    """
    members = found.select(
        F.concat(F.lit(folder.rstrip("/") + "/"), "archive").alias("path"),
        F.col("book").alias("member"),
        "book_id",
        *BOOK_KEY,
        F.col("title").alias("known_title"),
        F.col("author").alias("known_author"),
        F.col("authors").alias("known_authors"),
    )
    read = describe(read_archived(members, namespace))
    names = fallback_list(F.col("known_authors"), F.col("authors"))
    return read.withColumns(
        {
            "title": fallback(F.col("known_title"), F.col("title")),
            "author": fallback(F.col("known_author"), F.array_join(names, ", ")),
            "authors": names,
        }
    ).select("book_id", *BOOK_KEY, "uid", "title", "author", "authors", "sample", "error")


def changes(
    library: Library, read: DataFrame, encoder: Callable[[DataFrame], DataFrame]
) -> Library:
    """The rows that good rows of ``read_books`` add to (or replace in) the four tables.

    ``encoder`` adds ``embedding`` to rows with ``sample``. ``read`` feeds all tables, so
    write it (or checkpoint it) before: its archives should be read once.
    """
    books = read.select(
        F.col("book_id").alias("id"),
        *BOOK_KEY,
        "uid",
        "title",
        "author",
        F.current_timestamp().alias("added_at"),
    )
    vectors = encoder(read.select("book_id", "sample")).select("book_id", "embedding")
    authors, bridge = author_changes(library.authors, read.select("book_id", "authors"))
    return Library(books.select(library.books.columns), vectors, authors, bridge)


def add_books(
    library: Library, read: DataFrame, encoder: Callable[[DataFrame], DataFrame]
) -> Library:
    """The library after the books of ``read`` were inserted or replaced."""
    new = changes(library, read, encoder)
    return Library(
        upsert(library.books, new.books, BOOK_KEY),
        upsert(library.embeddings, new.embeddings, ["book_id"]),
        append(library.authors, new.authors),
        replace_groups(library.book_authors, new.book_authors, "book_id"),
    )


def backfill_authors(library: Library, folder: str) -> Library:
    """Authors, read from the documents, for books that have none in the bridge table."""
    named = library.book_authors.select(F.col("book_id").alias("id"))
    open_books = library.books.join(named, "id", "left_anti")
    unknown = F.lit(None).cast("string")
    found = open_books.select(
        F.col("id").alias("book_id"),
        *BOOK_KEY,
        unknown.alias("title"),
        unknown.alias("author"),
        F.lit(None).cast("array<string>").alias("authors"),
    )
    read = read_books(found, folder).where("error IS NULL").select("book_id", "authors")
    authors, bridge = save_authors(library.authors, library.book_authors, read)
    return Library(library.books, library.embeddings, authors, bridge)
