"""Queries that read the whole of what they are about."""

import os

import __spark_entry__ as driver
from kindred.operators import rerank
from kindred.plans import stand_ins

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_rounds_are_trained(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(rerank, "train", lambda rows, rounds=rerank.ROUNDS, **_: asked.append(rounds))
    driver._steps(spark, SF_DIR)
    assert asked == [rerank.ROUNDS]


def test_all_components_come_back(spark):
    got = {}
    for r in driver.queries()["blob_components"](spark, SF_DIR).collect():
        got.setdefault(r.book_id, {})[r.place] = r.value
    want = {r.book_id: r.embedding for r in stand_ins.vectors(spark, SF_DIR).collect() if r.embedding is not None}
    assert got == {b: dict(enumerate(v)) for b, v in want.items() if v}


def test_weak_stored_edges_are_served(spark):
    lists = driver.queries()["cached_or_compute_all"](spark, SF_DIR).collect()
    stored = {(r.book_id, r.similar_book_id) for r in stand_ins.edges(spark, SF_DIR).where("score <= 0.9").collect()}
    assert any((r.book_id, r.similar_book_id) in stored and r.score <= 0.9 for r in lists)
