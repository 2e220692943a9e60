"""The edge table ``similar`` and what is joined to it for readers.

Edges are ``book_id, similar_book_id, score``. Books, ratings and stored scores are attached
by equi-joins on ids; AQE splits the hot ones, none of them multiplies edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kindred.functions.display import authors_text, file_url, percent, percent_text, search_url
from kindred.functions.labels import BOOST_FACTOR, boost
from kindred.functions.text import author_list
from kindred.operators.similarity import check_limit
from kindred.sources.tables import latest, without

PAIR = ["book_id", "similar_book_id"]
BOOK_FIELDS = ["id", "book", "archive", "title", "author"]


def book_rows(books: DataFrame) -> DataFrame:
    """The book columns readers see, with the author list."""
    return books.select(*BOOK_FIELDS, author_list(F.col("author")).alias("authors"))


def with_books(edges: DataFrame, books: DataFrame) -> DataFrame:
    """Edges with structs ``source`` and ``candidate``; null for a book that is not known."""
    return with_candidates(_joined(edges, books, "book_id", "source"), books)


def with_candidates(edges: DataFrame, books: DataFrame) -> DataFrame:
    """Edges with the struct ``candidate``: what is shown of the other book alone, without a join of the source."""
    return _joined(edges, books, "similar_book_id", "candidate")


def _joined(edges: DataFrame, books: DataFrame, key: str, name: str) -> DataFrame:
    rows = book_rows(books)
    return edges.join(rows.select(F.col("id").alias(key), F.struct(*rows.columns).alias(name)), key, "left")


def ratings(feedback: DataFrame) -> DataFrame:
    return feedback.select(
        F.col("source_book_id").alias("book_id"),
        F.col("candidate_book_id").alias("similar_book_id"),
        "label",
    )


def with_rating(edges: DataFrame, feedback: DataFrame) -> DataFrame:
    """Edges with the reader's ``rating`` of the pair, 0 when there is none."""
    joined = edges.join(ratings(feedback), PAIR, "left")
    return joined.withColumn("rating", F.coalesce("label", F.lit(0.0))).drop("label")


def with_boost(edges: DataFrame, feedback: DataFrame, factor: float = BOOST_FACTOR) -> DataFrame:
    joined = edges.join(ratings(feedback), PAIR, "left")
    return joined.withColumn("boost", boost(F.col("label"), factor)).drop("label")


def stored_score(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs with the score of their edge, 0 when there is no such edge."""
    asked = edges.join(pairs.select(*PAIR).distinct(), PAIR, "left_semi")
    known = latest(asked.select(*PAIR, "score"), PAIR, F.desc("score"))
    joined = pairs.join(known.withColumnRenamed("score", "_score"), PAIR, "left")
    return joined.withColumn("stored_score", F.coalesce("_score", F.lit(0.0))).drop("_score")


def without_disliked(edges: DataFrame, feedback: DataFrame) -> DataFrame:
    """Edges whose pair has no negative rating."""
    return without(edges, ratings(feedback.where("label < 0")), PAIR)


def top_edges(edges: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` edges of every source with a 1-based ``rank``."""
    check_limit(limit)
    w = W.partitionBy("book_id").orderBy(F.desc("score"), "similar_book_id")
    return edges.withColumn("rank", F.row_number().over(w).cast("long")).where(
        F.col("rank") <= limit
    )


def top_edges_of(edges: DataFrame, book_id: int, limit: int) -> DataFrame:
    """The best ``limit`` edges of one source, without a shuffle of the table."""
    check_limit(limit)
    one = edges.where(F.col("book_id") == book_id)
    return one.orderBy(F.desc("score"), "similar_book_id").limit(limit)


def with_edges(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Requests (``book_id``) that have edges."""
    return requests.join(edges.select("book_id"), "book_id", "left_semi")


def edge_lists(edges: DataFrame, limit: int) -> DataFrame:
    """One row per source with its best ``limit`` edges as an array, best first."""
    item = F.struct("rank", "similar_book_id", "score")
    lists = top_edges(edges, limit).groupBy("book_id").agg(F.collect_list(item).alias("_edges"))
    ordered = F.transform(
        F.array_sort("_edges"), lambda e: F.struct(e["similar_book_id"], e["score"])
    )
    return lists.select("book_id", ordered.alias("edges"))


def touched_ids(pairs: DataFrame, *columns: str) -> DataFrame:
    """Distinct ids that occur in any of the given columns."""
    return pairs.select(F.explode(F.array(*columns)).alias("id")).distinct()


def ranked_view(
    edges: DataFrame, books: DataFrame, feedback: DataFrame, limit: int, base_url: str
) -> DataFrame:
    """What a reader is shown per source: rank, file, percent, title, authors, links, rating.

    The cut to ``limit`` comes first, so only shown edges meet books and ratings.
    """
    shown = with_candidates(with_rating(top_edges(edges, limit), feedback), books)
    return shown.select(
        "book_id",
        "rank",
        "similar_book_id",
        F.col("candidate.book").alias("file"),
        percent(F.col("score")).alias("percent"),
        F.col("candidate.title").alias("title"),
        authors_text(F.col("candidate.authors")).alias("authors"),
        _link(base_url, "title", F.col("candidate.title")).alias("title_url"),
        F.transform(
            F.col("candidate.authors"), lambda a: _link(base_url, "author", a)
        ).alias("author_urls"),
        "rating",
    )


def _link(base_url: str, kind: str, value: Column) -> Column:
    return F.when(value != "", search_url(base_url, kind, value))


def export_rows(edges: DataFrame, books: DataFrame, base_url: str) -> DataFrame:
    """``book_id, rank, percent, file, title, url`` rows, ready for ``write.csv``."""
    w = W.partitionBy("book_id").orderBy(F.desc("score"), "similar_book_id")
    ranked = edges.withColumn("rank", F.row_number().over(w).cast("long"))
    return with_candidates(ranked, books).select(
        "book_id",
        "rank",
        percent_text(F.col("score")).alias("percent"),
        F.col("candidate.book").alias("file"),
        F.col("candidate.title").alias("title"),
        file_url(base_url, F.col("candidate.book")).alias("url"),
    )
