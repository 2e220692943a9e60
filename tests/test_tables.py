import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import edges as E
from kindred.operators import feedback as fb
from kindred.operators import judge, lookups, rerank, reports
from kindred.plans.similar import bulk_edges, similar_books
from kindred.schemas import AUTHORS, BOOK_AUTHORS, BOOKS, COMMANDS, FEEDBACK, SIMILAR
from kindred.sources import feedback_json, tables
from kindred.streaming import feedback as stream

T0 = dt.datetime(2024, 1, 1)


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def edges_df(spark, rows):
    return spark.createDataFrame(rows, SIMILAR)


def pairs(df):
    return sorted((r.book_id, r.similar_book_id, r.score) for r in df.collect())


def test_upsert_and_replace(spark):
    old = edges_df(spark, [(1, 2, 0.5), (1, 3, 0.4), (2, 1, 0.5)])
    new = edges_df(spark, [(1, 9, 0.9)])
    assert pairs(tables.replace_groups(old, new, "book_id")) == [(1, 9, 0.9), (2, 1, 0.5)]
    assert pairs(tables.replace_groups(old, new.limit(0), "book_id")) == pairs(old)
    once = tables.upsert(old, new, ["book_id", "similar_book_id"])
    assert pairs(once) == pairs(tables.upsert(once, new, ["book_id", "similar_book_id"]))
    assert pairs(tables.append(old, new)) == sorted(pairs(old) + [(1, 9, 0.9)])
    assert tables.cleared(old).count() == 0
    assert pairs(tables.without(old, edges_df(spark, [(1, 3, 0.0)]), E.PAIR)) == [(1, 2, 0.5), (2, 1, 0.5)]


def test_numbers_are_consecutive_and_stable(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("name"))
    one = {r.name: r.id for r in tables.number(keys, ["name"], F.lit(10)).collect()}
    two = {r.name: r.id for r in tables.number(keys.repartition(7), ["name"], F.lit(10)).collect()}
    assert one == two and sorted(one.values()) == list(range(11, 511))


def test_books_keep_their_id(spark):
    none = spark.createDataFrame([], BOOKS)
    batch = "book string, archive string, uid string, title string, author string, added_at timestamp"
    first = tables.save_books(none, spark.createDataFrame(
        [("a", "z", "u", "T", "A", at(0)), ("a", "y", "u", "T", "A", at(0)), ("a", "z", "u", "T2", "A", at(1))], batch))
    ids = {(r.book, r.archive): r.id for r in first.collect()}
    assert len(ids) == 2 and {r.title for r in first.where("archive = 'z'").collect()} == {"T2"}
    second = tables.save_books(first, spark.createDataFrame(
        [("a", "z", "u", "T3", "A", at(2)), ("b", "z", None, None, None, at(2))], batch))
    got = {(r.book, r.archive): (r.id, r.title) for r in second.collect()}
    assert got["a", "z"] == (ids["a", "z"], "T3") and got["b", "z"] == (3, None) and len(got) == 3


def test_authors(spark):
    none = spark.createDataFrame([], AUTHORS), spark.createDataFrame([], BOOK_AUTHORS)
    schema = "book_id long, authors array<string>"
    one = tables.save_authors(*none, spark.createDataFrame([(1, ["A", "B", "A"]), (2, ["B"]), (3, [])], schema))
    assert one[0].count() == 2 and one[1].count() == 3
    two = tables.save_authors(*one, spark.createDataFrame([(1, ["C"]), (2, [])], schema))
    names = {r.id: r.name for r in two[0].collect()}
    assert len(names) == 3
    assert sorted((r.book_id, names[r.author_id]) for r in two[1].collect()) == [(1, "C"), (2, "B")]


def test_versioned_table(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), SIMILAR)
    assert table.read().count() == 0 and table.version() == 0
    table.write(edges_df(spark, [(1, 2, 0.5)]), "a")
    held = table.read()
    table.write(held.unionByName(edges_df(spark, [(3, 4, 0.1)])))  # reads what it replaces
    table.append(edges_df(spark, [(5, 6, 0.2)]), "b")
    table.append(edges_df(spark, [(5, 6, 0.2)]), "b")  # a replay
    assert pairs(table.read()) == [(1, 2, 0.5), (3, 4, 0.1), (5, 6, 0.2)]
    assert pairs(held) == [(1, 2, 0.5)] and table.has("a") and not table.has("c")


BOOK_ROWS = [
    (1, "1.fb2", "a", None, "One", "A, B", None),
    (2, "2.fb2", "a", None, "Two", "", None),
    (3, "3.fb2", "a", None, None, None, None),
    (4, "1.fb2", "b", None, "Copy", "A", None),
]


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(BOOK_ROWS, BOOKS)


def commands(spark, rows):
    return spark.createDataFrame(
        [(f"{s}.fb2", f"{c}.fb2", float(x), at(m), n) for n, (s, c, x, m) in enumerate(rows)], COMMANDS
    )


def ratings_of(df):
    return {(r.source_book_id, r.candidate_book_id): r.label for r in df.collect()}


def test_commands(spark, books):
    known, unknown = fb.resolve(
        commands(spark, [(1, 2, 0.4, 0), (1, 2, 1.0, 5), (1, 3, 0.6, 1), (1, 3, 0, 2), (2, 3, -1, 0), (9, 1, 1, 0)]), books
    )
    assert [r.source_file_name for r in unknown.collect()] == ["9.fb2"]
    none = spark.createDataFrame([], FEEDBACK)
    table = fb.apply_to_feedback(none, known)
    assert ratings_of(fb.stored(table)) == {(1, 2): 1.0, (2, 3): -1.0}
    edges = edges_df(spark, [(2, 3, 0.5), (1, 2, 0.5)])
    assert pairs(fb.apply_to_edges(edges, known)) == [(1, 2, 0.5)]
    # Replays and late commands change nothing; a newer one does.
    assert ratings_of(fb.apply_to_feedback(table, known)) == ratings_of(table)
    late, _ = fb.resolve(commands(spark, [(1, 3, 1.0, 1), (1, 2, 0.2, 9)]), books)
    assert ratings_of(fb.stored(fb.apply_to_feedback(table, late))) == {(1, 2): 0.2, (2, 3): -1.0}
    assert ratings_of(fb.mean_labels(known))[1, 2] == pytest.approx(0.7)


def test_feedback_json(spark, tmp_path):
    path = tmp_path / "f.json"
    path.write_text('{"feedback":[{"source_id":1,"candidate_id":2,"label":1,"created_at":"2024-01-01T00:00:00"},'
                    '{"source_id":1,"candidate_id":3,"label":-1}]}')
    rows = feedback_json.read_feedback(spark, str(path))
    assert ratings_of(rows) == {(1, 2): 1.0, (1, 3): -1.0} and rows.where("created_at IS NULL").count() == 0
    assert feedback_json.read_feedback(spark, str(tmp_path / "none.json")) is None
    out = str(tmp_path / "out")
    feedback_json.feedback_entries(rows).write.text(out)
    assert ratings_of(feedback_json.read_feedback(spark, out)) == ratings_of(rows)


def test_edge_views(spark, books):
    edges = edges_df(spark, [(1, 2, 0.4251), (1, 3, 0.9), (1, 7, 0.1), (2, 1, 0.3)])
    feedback = spark.createDataFrame([(1, 1, 2, 0.6, at(0)), (2, 1, 3, -1.0, at(0))], FEEDBACK)
    joined = {(r.book_id, r.similar_book_id): r for r in E.with_books(edges, books).collect()}
    assert joined[1, 7].candidate is None and joined[1, 2].source.authors == ["A", "B"]
    view = E.ranked_view(edges, books, feedback, 2, "u").where("book_id = 1").orderBy("rank").collect()
    assert [(r.file, r.percent, r.title, r.authors, r.rating) for r in view] == [
        ("3.fb2", 90.0, None, "—", -1.0), ("2.fb2", 42.51, "Two", "—", 0.6)
    ]
    assert pairs(E.without_disliked(edges, feedback)) == [(1, 2, 0.4251), (1, 7, 0.1), (2, 1, 0.3)]
    boosted = {(r.book_id, r.similar_book_id): r.boost for r in E.with_boost(edges, feedback).collect()}
    assert boosted[1, 2] == pytest.approx(0.24) and boosted[2, 1] == 0.0
    wanted = spark.createDataFrame([(1, 2), (4, 4)], "book_id long, similar_book_id long")
    assert {r.stored_score for r in E.stored_score(wanted, edges).collect()} == {0.4251, 0.0}
    assert [r.similar_book_id for r in E.top_edges_of(edges, 1, 2).collect()] == [3, 2]
    assert E.with_edges(wanted.select("book_id"), edges).count() == 1
    assert {r.id for r in E.touched_ids(edges, "book_id", "similar_book_id").collect()} == {1, 2, 3, 7}
    lists = {r.book_id: [e.similar_book_id for e in r.edges] for r in E.edge_lists(edges, 2).collect()}
    assert lists == {1: [3, 2], 2: [1]}
    row = E.export_rows(edges, books, "http://lib").where("book_id = 2").first()
    assert (row.percent, row.file, row.title) == (" 30.00", "1.fb2", "One")


def vectors(spark):
    return spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [0.8, 0.6])], "book_id long, embedding array<float>"
    )


def requests(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_name string")


def test_requests(spark, books):
    edges = edges_df(spark, [(2, 3, 0.7)])
    asked = requests(spark, "1.fb2", "2.fb2", "3.fb2", "no.fb2")
    answer = similar_books(asked, books, vectors(spark), edges, limit=5)
    assert [r.file_name for r in answer.unknown.collect()] == ["no.fb2"]
    # Book 2 is answered from its edge; book 1 sees 2 only (4 is the same file); 3 has no direction.
    assert sorted((r.book_id, r.similar_book_id) for r in answer.lists.collect()) == [(1, 2), (2, 3)]
    assert sorted((r.book_id, r.similar_book_id) for r in answer.edges.collect()) == [(1, 2), (2, 3)]
    assert answer.without_vector.count() == 0
    forced = similar_books(asked, books, vectors(spark), edges, limit=5, force=True)
    assert [r.similar_book_id for r in forced.lists.where("book_id = 2").orderBy("rank").collect()] == [4, 1]
    refilled = similar_books(asked, books, vectors(spark), edges, limit=2, refill=True)
    assert refilled.lists.where("book_id = 2").count() == 2
    other = similar_books(asked, books, vectors(spark), edges.limit(0), limit=5, exclude_same_author=True)
    assert other.lists.where("book_id = 1").count() == 1
    missing = similar_books(asked, books, vectors(spark).where("book_id = 2"), edges, limit=5)
    assert sorted(r.book_id for r in missing.without_vector.collect()) == [1, 3]
    none = similar_books(requests(spark, "no.fb2"), books, vectors(spark), edges)
    assert none.lists.count() == 0 and pairs(none.edges) == [(2, 3, 0.7)]


def test_bulk_edges(spark, books):
    got = bulk_edges(books, vectors(spark), limit=1)
    assert sorted((r.book_id, r.similar_book_id) for r in got.collect()) == [(1, 2), (2, 4), (4, 2)]


def test_training(spark):
    feedback = spark.createDataFrame(
        [(1, 1, 2, 0.5, at(0)), (2, 1, 3, 1.0, at(0)), (3, 2, 4, -1.0, at(0)), (4, 4, 1, 0.0, at(0)), (5, 8, 1, 1.0, at(0))],
        FEEDBACK,
    )
    rows = {(r.source_book_id, r.candidate_book_id): r for r in rerank.training_set(feedback, vectors(spark)).collect()}
    assert set(rows) == {(1, 2), (2, 4)} and rows[2, 4].weight == 1.2 and rows[1, 2].similarity == pytest.approx(0.6)
    with pytest.raises(ValueError):
        rerank.train(rerank.training_set(feedback.where("label = 0"), vectors(spark)))


def test_model_follows_the_labels(spark, tmp_path):
    rows = spark.range(400).select(
        (F.col("id") / 400).alias("similarity"),
        F.when(F.col("id") < 200, -0.5).otherwise(F.when(F.col("id") < 300, 1.0).otherwise(0.4)).alias("label"),
        F.lit(1.0).alias("weight"),
    )
    steps = rerank.train(rows, rounds=60)
    points = spark.createDataFrame([(0.2,), (0.6,), (0.9,)], "s double")
    low, high, middle = [r.p for r in points.select(steps.predict(F.col("s")).alias("p")).collect()]
    assert low == pytest.approx(-0.5, abs=0.1) and high == pytest.approx(1, abs=0.1) and middle == pytest.approx(0.4, abs=0.1)
    steps.save(spark, str(tmp_path / "m"))
    again = rerank.Steps.load(spark, str(tmp_path / "m"))
    assert list(again.edges) == list(steps.edges) and list(again.values) == list(steps.values)
    assert rerank.Steps.load(spark, str(tmp_path / "none")) is None
    one = rerank.train(rows.limit(3), rounds=2)
    assert len(one.values) == len(one.edges) + 1


def test_boosting_is_near_that_of_spark(spark):
    """Trees grown leaf by leaf, all shrunk, and trees grown level by level, the first of them whole, end at the
    same curve: no prediction is further off than 0.1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(4)
    x = np.sort(rng.random(600))
    label = np.sin(6 * x) + 0.1 * rng.normal(size=600)
    weight = 1 + rng.random(600)
    data = list(zip(x.tolist(), label.tolist(), weight.tolist()))
    rows = spark.createDataFrame(data, "similarity double, label double, weight double").coalesce(2)
    steps = rerank.train(rows, max_bins=60)
    binned = rows.withColumn("bin", rerank.step_of(F.col("similarity"), steps.edges).cast("double"))
    features = VectorAssembler(inputCols=["bin"], outputCol="features")
    model = GBTRegressor(weightCol="weight", stepSize=0.05, maxIter=20, maxDepth=5, maxBins=64).fit(features.transform(binned))
    both = model.transform(features.transform(binned)).withColumn("own", steps.predict(F.col("similarity"))).toPandas()
    assert np.abs(both.prediction - both.own).max() < 0.1 and np.abs(both.prediction - both.own).mean() < 0.03
    error = lambda p: float((weight * (p - label) ** 2).sum() / weight.sum())
    ordered = both.sort_values("similarity")
    assert error(ordered.own.to_numpy()) < 1.1 * error(ordered.prediction.to_numpy())


def test_trees_grow_leaf_by_leaf():
    weight, many = np.ones(8), np.full(8, 5.0)
    total = np.array([0, 0, 0, 0, 1, 1, 9, 9.0])
    two = rerank.boosted(weight, total, many, 1, 2, 1.0, 5)  # one split: before the nines
    assert np.allclose(two, [1 / 3] * 6 + [9] * 2)
    assert np.allclose(rerank.boosted(weight, total, many, 1, 3, 1.0, 5), total)
    assert np.allclose(rerank.boosted(weight, total, many, 1, 8, 1.0, 21), [2.5] * 8)  # leaves would be too small
    assert np.allclose(rerank.boosted(weight, total, many, 60, 31, 0.5, 5), total, atol=1e-5)


def test_reports(spark, books):
    feedback = spark.createDataFrame([(1, 1, 2, 0.5, at(0)), (2, 1, 4, 1.0, at(0))], FEEDBACK)
    rows = {r.similar_book_id: r for r in reports.score_report(feedback, edges_df(spark, [(1, 2, 0.9)]), vectors(spark)).collect()}
    assert (rows[2].stored_score, rows[4].stored_score) == (0.9, 0.0) and rows[4].score_now == pytest.approx(0.8)
    a, b = edges_df(spark, [(1, 2, 0.0), (1, 3, 0.0)]), edges_df(spark, [(1, 3, 0.0), (2, 1, 0.0)])
    got = {r.book_id: (r.n_one, r.n_other, r.n_common, r.overlap) for r in reports.overlap(a, b).collect()}
    assert got == {1: (2, 1, 1, 0.5), 2: (0, 1, 0, None)}
    assert [n for n, s in reports.timed({"a": lambda: a, "b": lambda: b}) if s >= 0] == ["a", "b"]


def test_judge(spark, books):
    edges = edges_df(spark, [(1, 2, 0.5), (1, 9, 0.6), (2, 1, 0.1)])

    def answers(prompts):
        if len(prompts) > 1 or "Название: Two\n    Автор: \n    \n    Кандидат" in prompts[0]:
            raise RuntimeError("busy")
        return [" 85 "]

    got = judge.label_edges(edges.coalesce(1), books, answers)
    assert ratings_of(got) == {(1, 2): 0.85}
    asked = judge.ask(judge.prompts(edges.coalesce(1), books), answers)
    assert ["busy" in r.error for r in judge.rejected(asked).collect()] == [True]
    asked = judge.ask(judge.prompts(edges, books), lambda prompts: ["many"] * len(prompts))
    assert {r.error for r in judge.rejected(asked).collect()} == {"no whole number"}


def test_commands_of_the_same_time_or_without_one(spark):
    old = spark.createDataFrame([(1, 1, 2, 0.2, at(5)), (2, 1, 3, 0.2, at(5)), (3, 1, 4, 0.2, at(5))], FEEDBACK)
    new = spark.createDataFrame(
        [(1, 2, 0.4, at(5), 1), (1, 3, 0.6, None, 2), (1, 4, 0.8, at(4), 3), (1, 5, 1.0, None, 4)],
        "source_book_id long, candidate_book_id long, label double, created_at timestamp, command_id long",
    )
    got = fb.apply_to_feedback(old, new)
    assert ratings_of(got) == {(1, 2): 0.4, (1, 3): 0.6, (1, 4): 0.2, (1, 5): 1.0}
    assert got.where("created_at IS NULL").count() == 0


def test_text_pairs(spark):
    feedback = spark.createDataFrame([(1, 1, 2, -1.0, at(0)), (2, 1, 5, 1.0, at(0)), (3, 2, 1, 0.0, at(0))], FEEDBACK)
    texts = spark.createDataFrame([(1, "one"), (2, "two")], "book_id long, sample string")
    row = fb.text_pairs(feedback, texts).collect()
    assert [(r.source_text, r.candidate_text, r.score) for r in row] == [("one", "two", 0.0)]


def test_feedback_stream(spark, books, tmp_path):
    store = stream.FeedbackStore(spark, str(tmp_path / "s"))
    store.replace_similar(edges_df(spark, [(1, 2, 0.5), (2, 3, 0.4)]))
    source = str(tmp_path / "in")

    def run():
        arriving = spark.readStream.schema(COMMANDS).parquet(source)
        stream.start(arriving, lambda: books, store, str(tmp_path / "c"), available_now=True).awaitTermination()

    commands(spark, [(1, 2, -1, 0), (1, 2, 0.8, 1), (2, 3, 0.4, 0), (7, 7, 1, 0)]).write.mode("append").parquet(source)
    run()
    assert ratings_of(store.feedback()) == {(1, 2): 0.8, (2, 3): 0.4}
    assert pairs(store.similar()) == [(2, 3, 0.4)] and store.rejected.read().count() == 1
    commands(spark, [(2, 3, 0, 5), (1, 2, 1.0, 0)]).write.mode("append").parquet(source)
    run()
    assert ratings_of(store.feedback()) == {(1, 2): 0.8}
    store.compact()
    assert pairs(store.edges.read()) == [(2, 3, 0.4)] and ratings_of(store.feedback()) == {(1, 2): 0.8}
    # A recomputed table may hold a pair that was disliked before.
    store.replace_similar(edges_df(spark, [(1, 2, 0.5)]))
    assert pairs(store.similar()) == [(1, 2, 0.5)]
    # The same batch again.
    batch = commands(spark, [(1, 3, 1.0, 0)])
    store.take(batch, books, "q-1")
    store.take(batch, books, "q-1")
    assert store.log.read().where("source_book_id = 1 AND candidate_book_id = 3").count() == 1


def test_lookups(spark, books):
    assert lookups.book_by_file(books, "1.fb2").first().id == 1
    assert lookups.book_by_file(books, "no.fb2").count() == 0
    assert lookups.book_by_id(books, 4).first().archive == "b"
    ids = spark.createDataFrame([(2,), (4,), (77,)], "id long")
    assert {r.id for r in lookups.books_by_ids(books, ids).collect()} == {2, 4}
    assert lookups.books_by_ids(books, ids.limit(0)).count() == 0
    assert lookups.vector_of(vectors(spark), 2).count() == 1 and lookups.vector_of(vectors(spark), 9).count() == 0
    assert {r.id for r in lookups.one_per_file(books).collect()} == {1, 2, 3}
    assert lookups.file_names(books).count() == 3
    assert lookups.books_with_vectors(books, vectors(spark)).count() == 4
    feedback = spark.createDataFrame([(1, 1, 2, 0.5, at(0)), (2, 3, 4, 1.0, at(0))], FEEDBACK)
    assert lookups.feedback_of(feedback, 3).first().candidate_book_id == 4
