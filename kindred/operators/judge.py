"""Labels for edges from a judge that answers prompts in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.display import judge_prompt
from kindred.functions.labels import judge_label
from kindred.operators.edges import top_edges, with_books
from kindred.sources.archives import pieces

JUDGED_EDGES = 100


def prompts(edges: DataFrame, books: DataFrame, limit: int = JUDGED_EDGES) -> DataFrame:
    """The prompt for each of the best ``limit`` edges of every source; unknown books drop out."""
    rows = with_books(top_edges(edges, limit), books)
    known = F.col("source").isNotNull() & F.col("candidate").isNotNull()
    return rows.where(known).select(
        F.col("book_id").alias("source_book_id"),
        F.col("similar_book_id").alias("candidate_book_id"),
        judge_prompt(
            F.col("source.title"),
            F.col("source.author"),
            F.col("candidate.title"),
            F.col("candidate.author"),
        ).alias("prompt"),
    )


def ask(asked: DataFrame, judge: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """Add ``answer`` and ``error``. A batch the judge fails on is asked one by one; a prompt it
    fails on alone has the failure as its ``error``."""

    def answers(batch: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(answer, None) for answer in judge(batch)]
        except Exception as failure:
            if len(batch) == 1:
                return [(None, repr(failure))]
            return [answer for prompt in batch for answer in answers([prompt])]

    names = ["source_book_id", "candidate_book_id", "prompt"]
    schema = "source_book_id long, candidate_book_id long, prompt string, answer string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Prompts become Python objects a piece at a time, and ids never do.
        for batch in batches:
            for piece in pieces(batch, "prompt"):
                got = answers(piece.column("prompt").to_pylist())
                added = [pa.array(column, pa.string()) for column in zip(*got)]
                yield pa.RecordBatch.from_arrays(piece.columns + added, [*names, "answer", "error"])

    return asked.select(*names).mapInArrow(run, schema)


def labels(answered: DataFrame) -> DataFrame:
    """Usable answers as feedback rows, ready for ``save_feedback``."""
    return (
        answered.withColumn("label", judge_label(F.col("answer")))
        .where(F.col("label").isNotNull())
        .select(
            "source_book_id",
            "candidate_book_id",
            "label",
            F.current_timestamp().alias("created_at"),
        )
    )


def rejected(answered: DataFrame) -> DataFrame:
    """What gave no label: prompts the judge failed on, and answers that are no number."""
    unusable = F.col("error").isNotNull() | judge_label(F.col("answer")).isNull()
    reason = F.coalesce("error", F.lit("no whole number"))
    return answered.where(unusable).withColumn("error", reason)


def label_edges(
    edges: DataFrame,
    books: DataFrame,
    judge: Callable[[list[str]], list[str | None]],
    limit: int = JUDGED_EDGES,
) -> DataFrame:
    return labels(ask(prompts(edges, books, limit), judge))
