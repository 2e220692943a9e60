"""The library's tables derived from general test tables, for queries, tests and the benchmark.

Every rule here has the same meaning in ANSI SQL (``SQL_VIEWS``), so a query over these views
can be compared with any other engine.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.session import parallelism
from kindred.sources.archives import pieces
from kindred.sources.catalogue import FIELD_SEPARATOR
from kindred.sources.markup import BOOK_NAMESPACE

LIBRARY_URL = "http://lib"
# Bytes of members that make an archive.
ARCHIVE_BYTES = 8 << 20

SQL_VIEWS = {
    "books": """
        SELECT p_partkey AS id, p_partkey || '.fb2' AS book, 'a' || p_size || '.zip' AS archive,
               p_name AS title, p_brand || ', ' || p_type AS author
        FROM part""",
    "vectors": "SELECT vec_id AS book_id, embedding FROM embeddings",
    "items": """
        SELECT b.id, b.book AS file, b.title, b.author,
               CAST(v.embedding AS DOUBLE[]) AS vec
        FROM books b JOIN vectors v ON v.book_id = b.id""",
    "edges": """
        SELECT l_partkey AS book_id, l_suppkey AS similar_book_id,
               max(l_quantity / 50 * (1 - l_discount)) AS score
        FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL""",
    "commands": """
        SELECT user_id || '.fb2' AS source_file_name, (event_id % 50) || '.fb2' AS candidate_file_name,
               user_id AS source_book_id, event_id % 50 AS candidate_book_id,
               CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.6 WHEN 'signup' THEN 0.2
                    WHEN 'error' THEN -1.0 ELSE 0.0 END AS label,
               ts AS created_at, event_id AS command_id
        FROM events WHERE user_id <> event_id % 50""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a few small files with one row group each, over all tasks. Many files are tasks enough and are not shuffled."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= tasks else rows.repartition(tasks)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        _file(F.col("p_partkey")).alias("book"),
        F.concat(F.lit("a"), F.col("p_size").cast("string"), F.lit(".zip")).alias("archive"),
        F.lit(None).cast("string").alias("uid"),
        F.col("p_name").alias("title"),
        F.concat_ws(", ", "p_brand", "p_type").alias("author"),
        F.lit(None).cast("timestamp").alias("added_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("book_id"), "embedding")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge table that grows with the largest test table."""
    score = F.col("l_quantity") / 50 * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_partkey") != F.col("l_suppkey"))
        .groupBy(F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("similar_book_id"))
        .agg(F.max(score).alias("score"))
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback commands by file name; a reader does not rate a book against itself."""
    return from_events(table(spark, sf_dir, "events"))


def from_events(events: DataFrame) -> DataFrame:
    source, candidate = F.col("user_id"), F.col("event_id") % 50
    kind = F.col("event_type")
    label = (
        F.when(kind == "purchase", 1.0)
        .when(kind == "click", 0.6)
        .when(kind == "signup", 0.2)
        .when(kind == "error", -1.0)
        .otherwise(0.0)
    )
    return events.where(source != candidate).select(
        _file(source).alias("source_file_name"),
        _file(candidate).alias("candidate_file_name"),
        label.alias("label"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("command_id"),
    )


def _file(number: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(".fb2"))


def catalogue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue lines of the parts: every 14-field rule occurs (short lines, deleted, languages)."""
    p = F.col
    key = p("p_partkey")
    fields = [
        F.concat_ws(":", F.concat_ws(",", "p_brand", "p_type"), F.concat(F.lit("B,"), p("p_type"))),
        p("p_type"),
        p("p_name"),
        F.lit(""),
        F.lit(""),
        key.cast("string"),
        p("p_size").cast("string"),
        key.cast("string"),
        F.when(p("p_size") == 7, "1").otherwise("0"),
        F.lit("fb2"),
        F.lit("2024-01-01"),
        F.when(p("p_size") % 3 == 0, "en").otherwise("ru"),
    ]
    line = F.concat_ws(FIELD_SEPARATOR, *fields)
    member = F.concat(F.lit("a"), p("p_size").cast("string"), F.lit(".inp"))
    return table(spark, sf_dir, "part").select(member.alias("member"), line.alias("line"))


def document_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as book markup: ``doc_id, archive, member, content``, one paragraph per line."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>")))
    content = F.concat(
        F.lit(f'<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="{BOOK_NAMESPACE}">'),
        F.lit("<description><title-info><author><first-name>"),
        _escaped(F.col("lang")),
        F.lit("</first-name><last-name>"),
        _escaped(F.col("source")),
        F.lit("</last-name></author><book-title>Document "),
        F.col("doc_id").cast("string"),
        F.lit("</book-title></title-info><document-info><id>d"),
        F.col("doc_id").cast("string"),
        F.lit("</id></document-info></description><body><section>"),
        F.array_join(lines, ""),
        F.lit("</section></body></FictionBook>"),
    )
    return docs.select(
        "doc_id",
        F.concat(F.lit("docs-"), F.col("lang"), F.lit(".zip")).alias("archive"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".fb2")).alias("member"),
        content.alias("content"),
    )


def _escaped(text: Column) -> Column:
    # Characters XML cannot hold become blanks, which the readers strip at line ends.
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", " ")
    amp = F.replace(plain, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit("\r"), F.lit("&#13;"))


def write_archives(members: DataFrame, folder: str) -> DataFrame:
    """Write rows ``archive, member, content`` as ZIP files, each by one task, in bounded pieces.

    An archive's rows may lie in several partitions, so file names get the partition's
    number; the written names come back as ``archive, member`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece.to_pandas() for whole in batches for piece in pieces(whole, "content", ARCHIVE_BYTES)):
            store, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (
                fs.LocalFileSystem(),
                folder,
            )
            store.create_dir(inner, recursive=True)
            for name, rows in batch.groupby("archive"):
                # Named by content, so a task that runs twice writes the same file.
                first = rows["member"].min().rsplit(".", 1)[0]
                archive = name.rsplit(".", 1)[0] + f"-{first}.zip"
                held = BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as out:
                    for row in rows.itertuples(index=False):
                        out.writestr(zipfile.ZipInfo(row.member), row.content)
                with store.open_output_stream(f"{inner}/{archive}") as target:
                    target.write(held.getvalue())
                written = [pa.array([archive] * len(rows), pa.string()), pa.array(rows["member"], pa.string())]
                yield pa.RecordBatch.from_arrays(written, ["archive", "member"])

    placed = members.repartitionByRange(
        parallelism(members.sparkSession), "archive", "member"
    ).sortWithinPartitions("archive", "member")
    return placed.select("archive", "member", "content").mapInArrow(
        run, "archive string, member string"
    )
