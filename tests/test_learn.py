"""Keyed state of ratings, and the learning job."""

import random
from datetime import datetime, timedelta

from kindred.operators import feedback as fb
from kindred.plans import learn
from kindred.schemas import BOOKS, COMMANDS, EMBEDDINGS, FEEDBACK, SIMILAR
from kindred.sources.feedback_json import feedback_entries
from kindred.streaming import ratings


def at(minute):
    return datetime(2026, 1, 1) + timedelta(minutes=minute)


def books(spark, n=6):
    return spark.createDataFrame([(i, f"{i}.fb2", "a.zip", None, f"Title {i}", f"Author {i}", None) for i in range(1, n)], BOOKS)


def by_pair(rows):
    return {(r.source_book_id, r.candidate_book_id): r.label for r in rows.collect()}


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, float(s)) for a, b, s in rows], SIMILAR)


def test_state_equals_the_batch_whatever_the_order(spark, tmp_path):
    pick, source = random.Random(5), str(tmp_path / "in")
    rows = [
        (f"{pick.randint(1, 7)}.fb2", f"{pick.randint(1, 4)}.fb2", pick.choice([-1.0, 0.0, 0.4, 1.0, None]), at(pick.randint(0, 20)), i)
        for i in range(120)
    ]
    rows += [("1.fb2", "2.fb2", 0.6, at(30), 500 + i) for i in range(60)]  # a hot pair of equal times
    pick.shuffle(rows)
    rows += [*rows[:25], (None, "1.fb2", 1.0, at(1), 900)]  # delivered twice; no book
    table = [(a, b, 0.5) for a in range(1, 6) for b in range(1, 5)]
    store = ratings.RatingStore(spark, str(tmp_path / "s"))
    store.replace_similar(edges(spark, *table))
    for part in (rows[:70], rows[70:71], rows[71:]):
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(COMMANDS).parquet(source)
        ratings.start(arriving, lambda: books(spark), store, str(tmp_path / "c"), available_now=True).awaitTermination()
    known, unknown = fb.resolve(spark.createDataFrame(rows, COMMANDS), books(spark))
    assert by_pair(store.feedback()) == by_pair(fb.stored(fb.newest(known)))
    want = fb.apply_to_edges(edges(spark, *table), known)
    assert sorted(store.similar().collect()) == sorted(want.collect())
    names = ["source_file_name", "candidate_file_name"]
    assert set(store.rejected().select(names).collect()) == set(unknown.select(names).collect())
    # A computed table may hold pairs that were disliked before.
    store.replace_similar(edges(spark, *table))
    assert store.similar().count() == len(table)


def test_a_late_dislike_takes_the_edge_and_leaves_the_rating(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "c")
    store = ratings.RatingStore(spark, str(tmp_path / "s"))
    store.replace_similar(edges(spark, (1, 2, 0.5), (2, 1, 0.5)))

    def feed(*rows):
        made = [(f"{a}.fb2", f"{b}.fb2", label, None if t is None else at(t), n) for a, b, label, t, n in rows]
        spark.createDataFrame(made, COMMANDS).write.mode("append").parquet(source)
        ratings.start(spark.readStream.schema(COMMANDS).parquet(source), lambda: books(spark), store, state, available_now=True).awaitTermination()

    feed((1, 2, 1.0, 10, 7))
    feed((1, 2, -1.0, 5, 3))
    assert by_pair(store.feedback()) == {(1, 2): 1.0} and [r.book_id for r in store.similar().collect()] == [2]
    feed((1, 2, 0.2, None, None))  # no time: as of its arrival
    assert by_pair(store.feedback()) == {(1, 2): 0.2}
    # What was committed is not taken again.
    token, version = ("q", 0), None
    change = spark.createDataFrame([("2.fb2", "1.fb2", 1, 1, -1.0, True)], ratings.CHANGE.replace("at long, command_id long, label double", ratings.KEPT))
    for _ in range(2):
        store.take(change, books(spark), token)
        assert version in (None, store.store.state().version)
        version = store.store.state().version
    assert store.similar().count() == 0


def feedback(spark, *rows):
    return spark.createDataFrame([(i, a, b, float(x), at(i)) for i, (a, b, x) in enumerate(rows)], FEEDBACK)


def test_ratings_are_replaced_as_a_whole(spark, tmp_path):
    store = learn.ratings(spark, str(tmp_path / "r"))
    for n, rows in enumerate([[(1, 2, 1), (2, 3, -1)], [(2, 3, 0.4), (4, 5, 1)]]):
        path = str(tmp_path / f"d{n}")
        feedback_entries(feedback(spark, *rows)).write.text(path)
        assert learn.sync(store, path)
        assert by_pair(store.read("feedback")) == {(a, b): x for a, b, x in rows}
    assert not learn.sync(store, str(tmp_path / "missing"))
    assert by_pair(store.read("feedback")) == {(2, 3): 0.4, (4, 5): 1.0}


def test_learning_job(spark, tmp_path):
    pick = random.Random(3)
    vectors = spark.createDataFrame([(i, [pick.gauss(0, 1) for _ in range(4)]) for i in range(1, 30)], EMBEDDINGS)
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(1, 20)], "book_id long, sample string")
    store, model = learn.ratings(spark, str(tmp_path / "r")), str(tmp_path / "m")
    none = edges(spark, (1, 2, 0.5)).limit(0)
    # Nothing to learn from, and no model there was.
    done = learn.learn(store, str(tmp_path / "missing"), vectors, none, model)
    assert (done.synced, done.trained, done.steps) == (False, False, None) and done.report.count() == 0
    pairs = {(pick.randint(1, 28), pick.randint(1, 28)): pick.choice([-1, 0.4, 1]) for _ in range(80)}
    feedback_entries(feedback(spark, *[(a, b, x) for (a, b), x in pairs.items()])).write.text(str(tmp_path / "d"))
    done = learn.learn(store, str(tmp_path / "d"), vectors, edges(spark, (1, 2, 0.5)), model, texts, str(tmp_path / "p"))
    assert done.synced and done.trained and done.report.count() == len(pairs)
    assert spark.read.parquet(str(tmp_path / "p")).count() == sum(a < 20 and b < 20 for a, b in pairs)
    # Ratings of books without vectors leave the model as it was.
    feedback_entries(feedback(spark, (900, 901, 1))).write.text(str(tmp_path / "e"))
    again = learn.learn(store, str(tmp_path / "e"), vectors, none, model)
    assert again.synced and not again.trained and list(again.steps.values) == list(done.steps.values)


def test_judge_labels_become_ratings(spark, tmp_path):
    store = learn.ratings(spark, str(tmp_path / "r"))
    store.commit(replaced={"feedback": feedback(spark, (1, 2, -1), (5, 1, 0.6))})
    answers = {"Title 2": "80", "Title 3": "no idea"}
    asked = []

    def judge(prompts):
        asked.extend(prompts)
        return [next((a for t, a in answers.items() if t in p.split("Title 1", 1)[-1]), "0") for p in prompts]

    bad = learn.judge_edges(store, edges(spark, (1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.1)), books(spark), judge, limit=2)
    assert [(r.candidate_book_id, r.answer) for r in bad.collect()] == [(3, "no idea")]
    rows = store.read("feedback").collect()
    assert {(r.source_book_id, r.candidate_book_id): r.label for r in rows} == {(1, 2): 0.8, (5, 1): 0.6}
    assert len({r.id for r in rows}) == 2 and store.state().version == 2




def test_the_state_of_a_pair_is_kept_without_python_and_tells_only_changes(spark, tmp_path):
    source, told = str(tmp_path / "in"), []

    def feed(*rows):
        made = [(f"{a}.fb2", f"{b}.fb2", label, at(t), n) for a, b, label, t, n in rows]
        spark.createDataFrame(made, COMMANDS).write.mode("append").parquet(source)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ratings.ROCKS)
        changes = ratings.changes(spark.readStream.schema(COMMANDS).parquet(source))
        # A call of Python for every pair takes too long where there are millions of them.
        assert "Pandas" not in changes._jdf.queryExecution().analyzed().toString()
        take = lambda rows, _: told.append({(r.source_file_name[0], r.candidate_file_name[0], r.label, r.command_id, r.disliked) for r in rows.collect()})
        writer = changes.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "c"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return set().union(*told[-1:])

    assert feed((1, 2, 0.4, 1, 1), (1, 2, -1.0, 0, 0), (1, 3, float("nan"), 1, 2)) == {("1", "2", 0.4, 1, True), ("1", "3", None, 2, False)}
    assert feed((1, 2, 0.4, 1, 1), (1, 3, 0.2, 1, 1)) == set()  # given before; older
    assert feed((1, 2, -1.0, 0, 0), (1, 3, 0.2, 1, 2)) == {("1", "2", None, None, True), ("1", "3", 0.2, 2, False)}


def test_pairs_are_not_shuffled_with_their_texts(spark):
    """many pairs of few candidates: the candidates' texts go to the pairs, whatever the size of all texts."""
    from pyspark.sql import functions as F

    from kindred.operators.feedback import text_pairs

    rows = spark.range(400).select(
        F.col("id").alias("source_book_id"), (F.col("id") % 3).alias("candidate_book_id"), F.lit(1.0).alias("label")
    )
    texts = spark.range(20_000).select(F.col("id").alias("book_id"), F.concat(F.lit("t"), F.col("id")).alias("sample"))
    texts = texts.where("book_id <> 7")
    for pair in (rows, rows.select(F.col("candidate_book_id").alias("source_book_id"), F.col("source_book_id").alias("candidate_book_id"), "label")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
        try:
            found = text_pairs(pair, texts)
            assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
            got = found.collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len(got) == 399 and all(r.source_text == f"t{r.source_book_id}" and r.candidate_text == f"t{r.candidate_book_id}" for r in got)
