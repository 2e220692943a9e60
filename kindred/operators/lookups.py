"""Reads of the library tables: by file, by id, by source, and counts.

Point reads push their filter to the scan; reads by a table of ids are semi-joins, which
Spark broadcasts while the ids are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.edges import BOOK_FIELDS
from kindred.sources.tables import latest


def projected(books: DataFrame) -> DataFrame:
    return books.select(*BOOK_FIELDS)


def book_by_file(books: DataFrame, file_name: str) -> DataFrame:
    """The book with this file name (the lowest id of several), or no row."""
    return projected(books.where(F.col("book") == file_name)).orderBy("id").limit(1)


def book_by_id(books: DataFrame, book_id: int) -> DataFrame:
    return projected(books.where(F.col("id") == book_id)).limit(1)


def books_by_ids(books: DataFrame, ids: DataFrame) -> DataFrame:
    """Books whose id is in ``ids`` (column ``id``); no ids give no books."""
    return projected(books).join(ids.select("id"), "id", "left_semi")


def vector_of(vectors: DataFrame, book_id: int) -> DataFrame:
    return vectors.where(F.col("book_id") == book_id).limit(1)


def feedback_of(feedback: DataFrame, source_book_id: int) -> DataFrame:
    return feedback.where(F.col("source_book_id") == source_book_id)


def books_with_vectors(books: DataFrame, vectors: DataFrame) -> DataFrame:
    """Books joined to their vector. Order by ``id`` where a reader needs the order."""
    return projected(books).join(
        vectors.select(F.col("book_id").alias("id"), "embedding"), "id"
    )


def count_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("n"))


def one_per_file(books: DataFrame) -> DataFrame:
    """One book per file name: the one with the lowest id."""
    return latest(projected(books), ["book"], F.col("id"))


def file_names(books: DataFrame) -> DataFrame:
    return books.select("book").distinct()
