"""Feedback exchange document: ``{"feedback": [{source_id, candidate_id, label, created_at?}]}``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.labels import feedback_time
from kindred.schemas import FEEDBACK, FEEDBACK_JSON
from kindred.sources.tables import number


def read_feedback(spark: SparkSession, path: str) -> DataFrame | None:
    """Feedback rows of the documents at ``path``; None when there are none to read.

    One JSON document per line, so a large export may be many lines in many files.
    """
    try:
        documents = spark.read.schema(FEEDBACK_JSON).json(path)
    except AnalysisException:
        return None
    return feedback_rows(documents)


def feedback_rows(documents: DataFrame) -> DataFrame:
    entry = documents.select(F.explode("feedback").alias("f"))
    rows = entry.select(
        F.col("f.source_id").alias("source_book_id"),
        F.col("f.candidate_id").alias("candidate_book_id"),
        F.col("f.label").alias("label"),
        feedback_time(F.col("f.created_at")).alias("created_at"),
    )
    pair = ["source_book_id", "candidate_book_id"]
    one = rows.groupBy(*pair).agg(
        F.max_by(F.struct("label", "created_at"), F.struct("created_at", "label")).alias("_r")
    )
    return number(one.select(*pair, "_r.*"), pair, F.lit(0)).select(FEEDBACK.names)


def feedback_entries(feedback: DataFrame) -> DataFrame:
    """One JSON document per rating, as ``value`` for ``write.text``.

    Every line is a complete exchange document, so an export of any size can be written by
    many tasks and read back with ``read_feedback``.
    """
    entry = F.struct(
        F.col("source_book_id").alias("source_id"),
        F.col("candidate_book_id").alias("candidate_id"),
        "label",
    )
    return feedback.select(F.to_json(F.struct(F.array(entry).alias("feedback"))).alias("value"))
