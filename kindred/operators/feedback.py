"""Reader feedback: commands, current ratings, and what they change in the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.labels import is_rated, unit_interval
from kindred.operators.edges import PAIR, ratings
from kindred.session import stage
from kindred.sources.tables import highest, latest, number, upsert, without

FEEDBACK_PAIR = ["source_book_id", "candidate_book_id"]


def resolve(commands: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File names of commands -> book ids: (resolved, commands that name an unknown book).

    A file name that several books carry means the lowest id. A command without a time has the
    time of its arrival.
    """
    arrived = F.coalesce("created_at", F.current_timestamp()).alias("created_at")
    # Only books that are named are grouped, so a small batch does not shuffle the table.
    names = commands.select(
        F.explode(F.array("source_file_name", "candidate_file_name")).alias("book")
    ).distinct()
    ids = books.join(names, "book", "left_semi").groupBy("book").agg(F.min("id").alias("id"))
    source = ids.select(
        F.col("book").alias("source_file_name"), F.col("id").alias("source_book_id")
    )
    candidate = ids.select(
        F.col("book").alias("candidate_file_name"), F.col("id").alias("candidate_book_id")
    )
    both = commands.join(source, "source_file_name", "left").join(
        candidate, "candidate_file_name", "left"
    )
    known = F.col("source_book_id").isNotNull() & F.col("candidate_book_id").isNotNull()
    return (
        both.where(known).select(*FEEDBACK_PAIR, "label", arrived, "command_id"),
        both.where(~known).select(commands.columns),
    )


def newest(commands: DataFrame) -> DataFrame:
    """The last command of every pair. Pre-aggregated, so a hot pair is no hot task."""
    last = F.max_by(
        F.struct("label", "created_at", "command_id"), F.struct("created_at", "command_id")
    )
    return (
        commands.groupBy(*FEEDBACK_PAIR)
        .agg(last.alias("_last"))
        .select(*FEEDBACK_PAIR, "_last.*")
    )


def mean_labels(feedback: DataFrame) -> DataFrame:
    """Mean label per pair."""
    return feedback.groupBy(*FEEDBACK_PAIR).agg(F.avg("label").alias("label"))


def stored(feedback: DataFrame) -> DataFrame:
    """Ratings without the marks that stand for a reset pair."""
    return feedback.where(is_rated(F.col("label")))


def apply_to_feedback(feedback: DataFrame, commands: DataFrame) -> DataFrame:
    """Feedback after resolved commands: a rating replaces, 0 resets.

    A reset stays as a row with label 0 (``stored`` hides it) and an older command never
    beats a newer row, so commands may be delivered twice or late. Of the same time, the command
    that comes later counts; one without a time is newer than any.
    """
    new = newest(commands.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())))
    seen = feedback.select(
        *FEEDBACK_PAIR, F.col("created_at").alias("_seen"), F.col("label").alias("_label")
    )
    changed = ~F.col("label").eqNullSafe(F.col("_label"))
    fresh = new.join(seen, FEEDBACK_PAIR, "left").where(
        F.col("_seen").isNull()
        | (F.col("created_at") > F.col("_seen"))
        | ((F.col("created_at") == F.col("_seen")) & changed)
    )
    rows = number(
        fresh.select(*FEEDBACK_PAIR, "label", "created_at"), FEEDBACK_PAIR, highest(feedback)
    )
    return upsert(feedback, rows, FEEDBACK_PAIR)


def apply_to_edges(edges: DataFrame, commands: DataFrame) -> DataFrame:
    """Edges after resolved commands: every disliked pair loses its edge."""
    return without(edges, ratings(commands.where("label < 0")), PAIR)


def rated_pairs(feedback: DataFrame) -> DataFrame:
    return stored(feedback).select(*FEEDBACK_PAIR, "label")


def text_pairs(feedback: DataFrame, texts: DataFrame) -> DataFrame:
    """Training pairs for an encoder: ``source_text, candidate_text, score`` in 0..1.

    ``texts`` has ``book_id, sample``. Pairs with an unknown book drop out. Texts are the
    big side: those of rated books are staged, once each. The side with fewer books is joined last, from a table
    of its own, whose size Spark knows: where it is small it is broadcast, and no pair is shuffled with a text.
    """
    pairs = stage(rated_pairs(feedback), "pairs")
    ids = F.explode(F.array(*FEEDBACK_PAIR)).alias("book_id")
    rated = stage(texts.select("book_id", "sample").join(pairs.select(ids).distinct(), "book_id", "left_semi"), "rated-texts")
    many = pairs.agg(*[F.countDistinct(c) for c in FEEDBACK_PAIR]).first()
    last, first = sorted(FEEDBACK_PAIR, key=lambda c: many[FEEDBACK_PAIR.index(c)])
    few = rated.join(pairs.select(F.col(last).alias("book_id")).distinct(), "book_id", "left_semi")
    joined = pairs
    for side, held in ((first, rated), (last, stage(few, "few-texts"))):
        text = F.col("sample").alias(side.replace("book_id", "text"))
        joined = joined.join(held.select(F.col("book_id").alias(side), text), side)
    return joined.select(*FEEDBACK_PAIR, "source_text", "candidate_text", unit_interval(F.col("label")).alias("score"))


def keep_latest(log: DataFrame) -> DataFrame:
    """Feedback rows of a log that may hold several per pair -> one per pair."""
    return latest(log, FEEDBACK_PAIR, F.desc("created_at"), F.desc("id"))
