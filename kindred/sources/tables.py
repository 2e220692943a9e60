"""Keyed tables over plain parquet: change functions, and versions on disk.

The change functions take the old table and a batch and return the new table. Batches are
small against tables, so each is an anti-join that Spark turns into a broadcast when the
batch is small enough, and the old rows are not shuffled. Tables on disk are those of ``store``: every new
state lies beside the old one, and a path that is being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from kindred.session import union
from kindred.sources.store import Store, Table

# Hex digits of a key's hash that pick its numbering group: 4,096 groups.
GROUP_DIGITS = 3


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order. Cuts before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Insert or replace by key; of several new rows per key the first in order counts."""
    new = latest(new, keys, *order) if order else new
    return union(without(old, new, keys), new.select(old.columns))


def without(old: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not in the batch."""
    return old.join(batch.select(*keys).distinct(), keys, "left_anti").select(old.columns)


def replace_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Replace all rows of every group in the batch; an empty batch changes nothing.

    The batch is read twice, so one that is costly to compute should be staged before."""
    return upsert(old, new, [key])


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return union(old, new.select(old.columns))


def cleared(old: DataFrame) -> DataFrame:
    return old.limit(0)


def number(keys: DataFrame, key: list[str], after: Column, name: str = "id") -> DataFrame:
    """Give distinct ``keys`` consecutive numbers after ``after``, without a global sort.

    Keys fall into groups by a hash of their text; a group's numbers follow those of the
    groups before it. The result depends on the keys only, so a retried task repeats it.
    """
    text = F.to_json(F.struct(*key)) if len(key) > 1 else F.col(key[0]).cast("string")
    grouped = keys.withColumn("_g", F.substring(F.md5(text), 1, GROUP_DIGITS))
    # At most 16 ** GROUP_DIGITS rows, whatever the number of keys.
    sizes = grouped.groupBy("_g").agg(F.count("*").alias("_size"))
    before = W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_g", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_at"))
    within = F.row_number().over(W.partitionBy("_g").orderBy(*key))
    return (
        grouped.join(F.broadcast(offsets), "_g")
        .withColumn(name, (after + F.col("_at") + within).cast("long"))
        .drop("_g", "_at")
    )


def highest(table: DataFrame, column: str = "id") -> Column:
    """The highest id of a table, 0 when it is empty."""
    return table.agg(F.coalesce(F.max(column), F.lit(0).cast("long"))).scalar()


BOOK_KEY = ["book", "archive"]


def book_ids(books: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct (book, archive) keys with an ``id``: the known one, or the next free ones."""
    # Only books of the batch are grouped: the table itself is not shuffled for a small batch.
    known = books.join(keys.select(*BOOK_KEY), BOOK_KEY, "left_semi").groupBy(*BOOK_KEY)
    matched = keys.join(known.agg(F.min("id").alias("id")), BOOK_KEY, "left")
    new = matched.where(F.col("id").isNull()).drop("id")
    return union(
        matched.where(F.col("id").isNotNull()), number(new, BOOK_KEY, highest(books))
    )


def book_changes(books: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows to insert or replace for a batch of books; a known (book, archive) keeps its id.

    ``batch`` has ``book, archive, uid, title, author, added_at``; the latest row counts.
    """
    order = [F.desc(c) for c in ("added_at", "title", "uid", "author")]
    return book_ids(books, latest(batch, BOOK_KEY, *order)).select(books.columns)


def save_books(books: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or replace books by (book, archive)."""
    return upsert(books, book_changes(books, batch), ["book", "archive"])


def save_embeddings(embeddings: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or replace vectors by book id; ``batch`` has one row per book."""
    return upsert(embeddings, batch, ["book_id"])


def author_changes(authors: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Author names of books (``book_id, authors``) -> (new author rows, their bridge rows)."""
    named = batch.select("book_id", F.explode(F.array_distinct("authors")).alias("name"))
    names = named.select("name").distinct()
    new = number(names.join(authors, "name", "left_anti"), ["name"], highest(authors))
    new = new.select(authors.columns)
    known = authors.join(names, "name", "left_semi").groupBy("name")
    ids = union(
        known.agg(F.min("id").alias("author_id")),
        new.select("name", F.col("id").alias("author_id")),
    )
    return new, named.join(ids, "name").select("book_id", "author_id")


def save_authors(
    authors: DataFrame, bridge: DataFrame, batch: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Add new names; replace the bridge rows of the batch's books.

    A book with an empty list keeps what it had.
    """
    new, rows = author_changes(authors, batch)
    return union(authors, new), replace_groups(bridge, rows, "book_id")


def save_feedback(feedback: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or replace ratings by (source, candidate); the newest of a pair counts.

    ``batch`` has ``source_book_id, candidate_book_id, label, created_at``. A replaced
    rating gets a new id, like every inserted row.
    """
    key = ["source_book_id", "candidate_book_id"]
    new = latest(batch, key, F.desc("created_at"), F.desc("label"))
    return upsert(feedback, number(new, key, highest(feedback)), key)


class VersionedTable:
    """One table without a key, in a ``Store`` of its own.

    ``write`` starts anew, ``append`` adds rows. A ``token`` names a change: the same change again (a
    replayed stream batch) does nothing. Of tokens ``name-number`` only the last number of a name is
    kept, so they must grow.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.store = Store(spark, path, {"rows": Table(schema, buckets=1)})

    def read(self) -> DataFrame:
        return self.store.read("rows")

    def write(self, rows: DataFrame, token: str | None = None) -> DataFrame:
        self.store.commit(replaced={"rows": rows}, mark=mark_of(token))
        return self.read()

    def append(self, rows: DataFrame, token: str | None = None) -> DataFrame:
        self.store.commit({"rows": rows}, mark=mark_of(token))
        return self.read()

    def version(self) -> int:
        return self.store.state().version

    def has(self, token: str) -> bool:
        return self.store.applied(*mark_of(token))


def mark_of(token: str | None) -> tuple[str, int] | None:
    """A token as (source, number)."""
    if token is None:
        return None
    name, _, number = token.rpartition("-")
    return (name, int(number)) if name and number.isdigit() else (token, 0)
