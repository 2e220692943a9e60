"""Feedback commands as a stream.

A micro-batch only appends: its newest command per pair goes to a log, so its cost does not
depend on the size of the feedback or edge table. Readers see log and tables together;
``compact`` folds the log into the tables now and then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StructField,
    StructType,
    TimestampType,
)

from kindred.operators.edges import PAIR
from kindred.operators.feedback import FEEDBACK_PAIR, resolve, stored
from kindred.schemas import COMMANDS, SIMILAR
from kindred.session import query_id
from kindred.sources.tables import VersionedTable, without

# ``disliked``: a command of the pair since the last compaction was a dislike.
LOG = StructType(
    [
        StructField("source_book_id", LongType()),
        StructField("candidate_book_id", LongType()),
        StructField("label", DoubleType()),
        StructField("created_at", TimestampType()),
        StructField("command_id", LongType()),
        StructField("disliked", BooleanType()),
    ]
)


def fold(rows: DataFrame) -> DataFrame:
    """Log rows (or commands with ``disliked``) -> one per pair: the newest, and any dislike."""
    last = F.max_by(
        F.struct("label", "created_at", "command_id"), F.struct("created_at", "command_id")
    )
    folded = rows.groupBy(*FEEDBACK_PAIR).agg(
        last.alias("_last"), F.bool_or("disliked").alias("disliked")
    )
    return folded.select(*FEEDBACK_PAIR, "_last.*", "disliked")


class FeedbackStore:
    """Feedback log, edge table and rejected commands under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = VersionedTable(spark, f"{path}/feedback", LOG)
        self.edges = VersionedTable(spark, f"{path}/similar", SIMILAR)
        self.rejected = VersionedTable(spark, f"{path}/rejected", COMMANDS)

    def feedback(self) -> DataFrame:
        """Current ratings; the number of the command serves as their id."""
        rows = stored(fold(self.log.read()))
        return rows.select(
            F.col("command_id").alias("id"), *FEEDBACK_PAIR, "label", "created_at"
        )

    def similar(self) -> DataFrame:
        """Current edges: those of the table without the pairs disliked since."""
        disliked = self.log.read().where("disliked").toDF(*PAIR, *LOG.names[2:])
        return without(self.edges.read(), disliked, PAIR)

    def replace_similar(self, edges: DataFrame) -> None:
        """A new edge table. Dislikes given before do not apply to it."""
        self.edges.write(edges)
        self._mark_applied()

    def compact(self) -> None:
        """Fold the log into the tables; run it while no micro-batch is running."""
        self.edges.write(self.similar())
        self._mark_applied()

    def take(self, commands: DataFrame, books: DataFrame, token: str) -> None:
        """Apply a batch of commands; the same token twice applies once."""
        if self.log.has(token):
            return
        known, unknown = resolve(commands, books)
        self.rejected.append(unknown, token)
        self.log.append(fold(known.withColumn("disliked", F.col("label") < 0)), token)

    def _mark_applied(self) -> None:
        self.log.write(fold(self.log.read()).withColumn("disliked", F.lit(False)))


def start(
    commands: DataFrame,
    books: Callable[[], DataFrame],
    store: FeedbackStore,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Feed a stream of commands (``COMMANDS``) into the store.

    ``books`` is asked anew for every batch, so that new books resolve.
    """

    def take(batch: DataFrame, number: int) -> None:
        store.take(batch, books(), f"{query_id(batch)}-{number}")

    writer = commands.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
