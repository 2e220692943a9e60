"""Feedback commands as a stream with a state for each pair of books.

The state is the newest command of the pair, so a late, repeated or equally old command is decided where it
arrives. Only changes leave the state, and the table of ratings is current as it lies: reading folds no log. A
micro-batch is one commit over ratings, edges and rejected commands; its replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.edges import PAIR
from kindred.operators.feedback import FEEDBACK_PAIR, resolve, stored
from kindred.schemas import COMMANDS, SIMILAR
from kindred.session import query_id, stage
from kindred.sources.store import Store, Table
from kindred.streaming.feedback import LOG

NAMES = ["source_file_name", "candidate_file_name"]
# What ``changes`` gives.
KEPT = "at long, command_id long, label double"
CHANGE = f"source_file_name string, candidate_file_name string, {KEPT}, disliked boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Stands for a command without a number, which comes before all that have one.
NO_NUMBER = -(1 << 63)

TABLES = {
    "feedback": Table(LOG, tuple(FEEDBACK_PAIR)),
    "similar": Table(SIMILAR, tuple(PAIR)),
    "rejected": Table(COMMANDS),
}


class RatingStore:
    """Ratings by pair, edges, and commands that name unknown books, under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path, TABLES)

    def feedback(self) -> DataFrame:
        """Current ratings; the number of the command serves as their id."""
        rows = stored(self.store.read("feedback"))
        return rows.select(F.col("command_id").alias("id"), *FEEDBACK_PAIR, "label", "created_at")

    def similar(self) -> DataFrame:
        return self.store.read("similar")

    def rejected(self) -> DataFrame:
        """Commands about unknown books: of each pair those that were newest when they came."""
        return self.store.read("rejected")

    def replace_similar(self, edges: DataFrame) -> None:
        """A new edge table. Dislikes given before do not apply to it."""
        self.store.commit(replaced={"similar": edges})

    def take(self, changes: DataFrame, books: DataFrame, token: tuple[str, int]) -> None:
        """What the state gave for a micro-batch."""
        if self.store.applied(*token):
            return
        # Written first: the state must not be asked again for each table.
        changes = stage(changes, "changes")
        # ``at`` is null where an older command was a dislike: it takes the edge, and leaves the rating.
        commands = changes.select(
            *NAMES,
            "label",
            F.timestamp_micros("at").alias("created_at"),
            F.when(F.col("command_id") != NO_NUMBER, F.col("command_id")).alias("command_id"),
        )
        newer = commands.where("created_at IS NOT NULL")
        known, unknown = resolve(newer, books)
        gone, _ = resolve(commands.join(changes.where("disliked").select(*NAMES), NAMES, "left_semi"), books)
        pairs = gone.select(*[F.col(c).alias(p) for c, p in zip(FEEDBACK_PAIR, PAIR)], F.lit(None).cast("double").alias("score"))
        self.store.commit(
            {"feedback": known.withColumn("disliked", F.col("label") < 0).select(LOG.names), "rejected": unknown},
            removed={"similar": pairs},
            mark=token,
        )
        for name in TABLES:
            self.store.compact(name)


def changes(commands: DataFrame) -> DataFrame:
    """A stream of commands -> what they change, by pair. A command without a time has that of its arrival.

    The state of a pair is an aggregate: its newest command, and when it and the last dislike arrived. What arrived
    with this micro-batch is told by the batch's own time, which its replay has too."""
    arrival = F.unix_micros(F.current_timestamp())
    placed = commands.select(
        *NAMES,
        F.unix_micros(F.coalesce("created_at", F.current_timestamp())).alias("at"),
        F.coalesce("command_id", F.lit(NO_NUMBER)).alias("command_id"),
        F.when(~F.isnan("label"), F.col("label")).alias("label"),
        arrival.alias("arrival"),
    )
    # Of equal commands the first to arrive stays, so that a repeated one is no change.
    last = F.max(F.struct("at", "command_id", "label", (-F.col("arrival")).alias("before")))
    held = placed.groupBy(*NAMES).agg(last.alias("last"), F.max(F.when(F.col("label") < 0, F.col("arrival"))).alias("dislike"))
    now = F.unix_micros(F.current_timestamp())
    told = held.withColumns({"new": F.col("last.before") == -now, "disliked": F.coalesce(F.col("dislike") == now, F.lit(False))})
    kept = [F.when(F.col("new"), F.col(f"last.{c}")).alias(c) for c in ("at", "command_id", "label")]
    return told.where("new OR disliked").select(*NAMES, *kept, "disliked")


def start(
    commands: DataFrame,
    books: Callable[[], DataFrame],
    store: RatingStore,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Feed a stream of commands (``COMMANDS``) through the state into the store.

    ``books`` is asked anew for every batch. The state lies in RocksDB, to which the session is set: it need not fit memory."""
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def take(batch: DataFrame, number: int) -> None:
        store.take(batch, books(), (query_id(batch), number))

    writer = changes(commands).writeStream.outputMode("update").foreachBatch(take)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
