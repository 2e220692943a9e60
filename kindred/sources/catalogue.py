"""Catalogue scans: INPX lines, or plain archive listings, to rows of new books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import catalogue_authors, strip
from kindred.sources.archives import list_members, read_lines, split_errors
from kindred.session import stage, union

# The catalogue line format.
FIELD_SEPARATOR = "\x04"
FIELDS = (
    "author",
    "genere",
    "title",
    "series",
    "serno",
    "file",
    "size",
    "libid",
    "deleted",
    "ext",
    "date",
    "lang",
    "librate",
    "keywords",
)
DELETED = "1"
LANGUAGE = "ru"

INPX = "inpix"
ZIP = "zip"

BOOK_COLUMNS = ["archive", "book", "title", "author", "authors"]


def inpx_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every member of one catalogue archive: ``archive, member, line, error``.

    An archive, member or line that cannot be read is a row with an ``error``.
    """
    good, broken = split_errors(list_members(spark, path, glob=None))
    columns = ["archive", "member", F.lit(None).cast("string").alias("line"), "error"]
    return union(read_lines(good), broken.select(columns))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Catalogue fields of every non-blank ``line``; missing fields are empty."""
    line = strip(F.col("line"))
    parts = F.split(line, FIELD_SEPARATOR)
    kept = lines.where(line != "").withColumn("_parts", parts)
    fields = {name: F.coalesce(F.get("_parts", F.lit(i)), F.lit("")) for i, name in enumerate(FIELDS)}
    fields["deleted"] = fields["deleted"] == DELETED
    return kept.withColumns(fields).drop("_parts")


def eligible(records: DataFrame, language: str = LANGUAGE) -> DataFrame:
    return records.where(
        (F.col("lang") == language) & ~F.col("deleted") & (F.col("file") != "")
    )


def catalogue_books(records: DataFrame) -> DataFrame:
    """Parsed records with their ``member`` -> books: where they lie and what they are."""
    # The extension is what follows the last dot of the last path part, unless only dots precede.
    stem = F.regexp_replace("member", r"([^/.][^/]*)\.[^./]*\z", "$1")
    authors = catalogue_authors(F.col("author"))
    return records.select(
        F.concat(stem, F.lit(".zip")).alias("archive"),
        F.concat_ws(".", "file", "ext").alias("book"),
        "title",
        F.array_join(authors, ", ").alias("author"),
        authors.alias("authors"),
    )


def listed_books(members: DataFrame) -> DataFrame:
    """Archive listing -> books of which nothing but the place is known."""
    unknown = F.lit(None).cast("string")
    return members.where("error IS NULL").select(
        "archive",
        F.col("member").alias("book"),
        unknown.alias("title"),
        unknown.alias("author"),
        F.lit(None).cast("array<string>").alias("authors"),
    )


def unseen(found: DataFrame, books: DataFrame) -> DataFrame:
    """Found books whose file name is not in ``books`` yet (the archive does not matter)."""
    return found.join(books.select("book"), "book", "left_anti").select(found.columns)


def scan_catalogue(
    spark: SparkSession,
    kind: str,
    location: str,
    books: DataFrame,
    language: str = LANGUAGE,
) -> tuple[DataFrame, DataFrame]:
    """New books of a library, from its catalogue (``inpix``) or its archives (``zip``), and
    what could not be read: ``archive, member, error``."""
    if kind == INPX:
        lines = stage(inpx_lines(spark, location), "catalogue")
        found = catalogue_books(eligible(parse_lines(lines.where("error IS NULL")), language))
    elif kind == ZIP:
        lines = stage(list_members(spark, location), "listing")
        found = listed_books(lines)
    else:
        raise ValueError(f"unknown catalogue kind: {kind}")
    return unseen(found, books), lines.where("error IS NOT NULL").select("archive", "member", "error")
