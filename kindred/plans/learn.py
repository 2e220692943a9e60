"""The learning job: ratings from an exchange document, a model of them, and what it changes.

Ratings of the document replace the stored ones as a whole. The model is trained anew where rated pairs have
vectors, and stays as it was where none have. Pairs of texts for an encoder are written beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kindred.operators import judge
from kindred.operators.feedback import stored, text_pairs
from kindred.operators.reports import score_report
from kindred.operators.rerank import Steps, train, training_set
from kindred.schemas import FEEDBACK
from kindred.session import stage
from kindred.sources.feedback_json import read_feedback
from kindred.sources.store import Store, Table
from kindred.sources.tables import save_feedback

RATINGS = {"feedback": Table(FEEDBACK, ("source_book_id", "candidate_book_id"))}


@dataclass(frozen=True)
class Learned:
    """``synced``: the document could be read. ``trained``: there was something to learn from. ``steps``: the model
    in force, None if there never was one. ``report``: stored and current score of each rated pair."""

    synced: bool
    trained: bool
    steps: Steps | None
    report: DataFrame


def ratings(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, RATINGS)


def sync(store: Store, documents: str) -> bool:
    """Stored ratings become those of the documents, all at once. False, and nothing changes, if there are none to read."""
    rows = read_feedback(store.spark, documents)
    if rows is None:
        return False
    return store.commit(replaced={"feedback": rows})


def learn(
    store: Store,
    documents: str,
    vectors: DataFrame,
    edges: DataFrame,
    model: str,
    texts: DataFrame | None = None,
    pairs: str | None = None,
) -> Learned:
    """Take over ratings, train on them and save the model at ``model``; text pairs go to ``pairs``.

    ``texts`` has ``book_id, sample``. Pairs whose books lack vectors are not learnt from."""
    synced = sync(store, documents)
    feedback = stored(store.read("feedback"))
    rows = stage(training_set(feedback, vectors), "rated")
    trained = not rows.isEmpty()
    if trained:
        steps = train(rows)
        steps.save(store.spark, model)
    else:
        steps = Steps.load(store.spark, model)
    if texts is not None and pairs is not None:
        text_pairs(feedback, texts).write.mode("overwrite").parquet(pairs)
    return Learned(synced, trained, steps, score_report(feedback, edges, vectors))


def judge_edges(
    store: Store, edges: DataFrame, books: DataFrame, ask: Callable[[list[str]], list[str | None]], limit: int = judge.JUDGED_EDGES
) -> DataFrame:
    """Ask a judge about the best edges of every book and store its labels as ratings; returns what gave no label.

    Each prompt is asked once. A label takes the place of the pair's older rating."""
    answered = stage(judge.ask(judge.prompts(edges, books, limit), ask), "answered")
    # Written before numbering: labels carry the time they are made at, and numbering reads its rows twice.
    labels = stage(judge.labels(answered), "labels")
    state = store.state()
    held = store.read("feedback", state)
    after = save_feedback(held, labels)
    changed = after.join(labels, ["source_book_id", "candidate_book_id"], "left_semi")
    store.commit({"feedback": changed.select(FEEDBACK.names)}, based_on=state.version)
    return judge.rejected(answered)
