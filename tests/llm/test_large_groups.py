"""Work that must not grow with the square of the input on disk: what a task is given, and the same results."""

import random

import numpy as np

from kindred.llm import jaccard, near_vectors


def test_texts_of_a_large_group_are_not_shuffled_to_each_tile(docs_of, monkeypatch):
    """Members of a group of many parts went by every other part: as many copies of a text as parts."""
    pick = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[:k % 50] + [f"x{pick.randrange(9)}"] + words[k % 50 + 1 :])) for k in range(60)]
    rows += [(100 + k, f"apart {k} from all others and of two") for k in range(2)] + [(7, "some other text of the same id")]
    whole = {tuple(r) for r in jaccard.jaccard_classes(docs_of(rows), 4, 80).collect()}
    given = []
    plain = jaccard.searched
    monkeypatch.setattr(jaccard, "searched", lambda rows, *more: (given.append(rows.count()), plain(rows, *more))[1])
    monkeypatch.setattr(jaccard, "PART", 300)
    assert {tuple(r) for r in jaccard.jaccard_classes(docs_of(rows), 4, 80).collect()} == whole
    assert sum(given) <= len(rows)
    assert len({r[2] for r in whole if r[0] < 60 and r[0] != 7}) == 1
    # Where tasks cannot open the folder the texts are shuffled, with the same result.
    monkeypatch.setattr(jaccard.stored, "readable", lambda name: False)
    assert {tuple(r) for r in jaccard.jaccard_classes(docs_of(rows), 4, 80).collect()} == whole


def test_blocks_of_vectors_are_not_shuffled_to_each_they_meet(spark, monkeypatch):
    """Each pair of blocks was a row with the components of one, which grew with the square of the vectors."""
    make = np.random.default_rng(5)
    base = make.normal(size=(20, 16))
    rows = [(i, [float(x) for x in base[i % 20] + make.normal(size=16) * (0.1 if i % 3 else 1.0)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(near_vectors, "BLOCK", 20)
    shuffled = []
    plain = near_vectors._met_in_strips
    monkeypatch.setattr(near_vectors, "_met_in_strips", lambda *given: (shuffled.append(1), plain(*given))[1])
    sizes = []
    keep = near_vectors.staged
    monkeypatch.setattr(near_vectors, "staged", lambda rows, name: (sizes.append((name, "data" in rows.columns)), keep(rows, name))[1])
    found = {tuple(r) for r in near_vectors.near_vectors(table).collect()}
    assert not shuffled and not any(data for _, data in sizes)
    # Where tasks cannot open the files they are, with the same result.
    monkeypatch.setattr(near_vectors.stored, "readable", lambda name: False)
    assert {tuple(r) for r in near_vectors.near_vectors(table).collect()} == found and shuffled
    assert sum(r[1] for r in found) > 100
