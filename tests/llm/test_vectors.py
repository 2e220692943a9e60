import math

import numpy as np
import pytest

from kindred.llm import near_vectors, topk


@pytest.fixture(scope="module")
def rows():
    make = np.random.default_rng(1)
    base = make.normal(size=(30, 16))
    out = []
    for i in range(300):
        v = base[make.integers(30)] * make.uniform(0.5, 2) + make.normal(size=16) * make.choice([0, 0.1, 0.25, 0.4])
        out.append((i, [float(np.float32(x)) for x in v]))
    for i, v in ((10, None), (11, [0.0] * 16), (12, [float("nan")] + [1.0] * 15), (13, [None] + [1.0] * 15), (14, []), (15, [1.0, 2.0]), (50, [2.0, 4.0])):
        out[i] = (i, v)
    for i in range(100, 130):
        out[i] = (i, out[100][1])
    return [*out, (20, out[20][1]), (None, out[21][1])]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, score string").repartition(4)


def usable(rows):
    return {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}


@pytest.mark.parametrize("block", [2048, 40])
def test_near_vectors(table, rows, block, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    vectors = usable(rows)
    up = {i: i for i, _ in rows if i is not None}
    links = dict.fromkeys(up, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in vectors:
        for b in vectors:
            x, y = vectors[a], vectors[b]
            if a < b and len(x) == len(y) and x.any() and y.any() and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                up[q] = p
    got = near_vectors.near_vectors(table).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], root(r.vec_id), root(r.vec_id) == r.vec_id)
    assert sum(links.values()) > 500


@pytest.mark.parametrize(("block", "queries"), [(2048, 4096), (37, 4)])
def test_top_k(table, rows, block, queries, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    whole = {i: np.floor(256 * v).astype(int) for i, v in usable(rows).items()}
    want = set()
    for i, q in whole.items():
        if i % 50 == 0:
            best = sorted((-int(q @ x), j) for j, x in whole.items() if j != i and len(x) == len(q))[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    got = topk.top_k(table, table.where("vec_id % 50 = 0"), 5)
    assert {tuple(r) for r in got.collect()} == want


def test_no_vectors(table):
    none = table.limit(0)
    assert near_vectors.near_vectors(none).count() == 0
    assert topk.top_k(none, none, 5).count() == 0
