import numpy as np
import pytest
from brute import top_k
from pyspark.sql import functions as F

from kindred.operators import blocks, kernel
from kindred.operators.cells import CellIndex, cell_top_k
from kindred.operators.kernel import Rules
from kindred.operators.rerank import Steps, exact_top_k_rescored, rescore
from kindred.operators.similarity import (
    block_counts,
    exact_top_k,
    library_items,
    neighbour_pool,
    overfetch,
    self_blocks,
    top_k_overfetched,
)
from kindred.plans.similar import search

SCHEMA = "id long, file string, title string, authors array<string>, vec array<float>"


def make_items(n=240, dim=6, seed=3):
    """Random vectors with every awkward case: copies, opposites, zeros, nulls, null titles."""
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(n, dim)).astype(np.float32)
    vecs[10] = vecs[11] = vecs[12]  # ties
    vecs[20] = -vecs[21]
    vecs[30] = 0
    vecs[31] = 1e-10
    vecs[40] *= 1000
    items = []
    for i in range(n):
        title = None if i % 17 == 0 else f"t{rng.integers(0, 40)}"
        authors = [f"a{a}" for a in rng.permutation(25)[: rng.integers(0, 4)]]
        file = None if i == 50 else ("same.fb2" if i in (60, 61) else f"{i}.fb2")
        # A third of all books is one title by one author.
        if i % 3 == 0 and i % 17:
            title, authors = "hot", ["a1"]
        items.append(dict(id=i, file=file, title=title, authors=authors, vec=vecs[i].tolist()))
    return items


def frame(spark, items):
    rows = [(i["id"], i["file"], i["title"], i["authors"], i["vec"]) for i in items]
    return spark.createDataFrame(rows, SCHEMA)


def as_dict(lists):
    return {(r.book_id, r.similar_book_id): (r.score, r["rank"]) for r in lists.collect()}


@pytest.fixture(scope="module")
def items():
    return make_items()


@pytest.fixture(scope="module")
def df(spark, items):
    return frame(spark, items).repartition(4).cache()


RULES = [
    dict(),
    dict(same_title=False, dedup="none"),
    dict(same_file=False, same_title=False, dedup="best"),
    dict(same_author=True),
    dict(dedup="first"),
    dict(dedup="first", same_author=False, same_title=False),
]


@pytest.mark.parametrize("rules", RULES, ids=str)
@pytest.mark.parametrize("path", ["few", "tiles"])
def test_exact_equals_brute_force(items, df, rules, path, monkeypatch):
    few = path == "few"
    if few and rules.get("dedup") == "first":
        pytest.skip("this rule has the tiles only")
    if not few:
        monkeypatch.setattr("kindred.operators.similarity.MIN_BLOCK_ROWS", 20)
    found = exact_top_k(df, df, 7, Rules(**rules), block_rows=50, few=few)
    assert as_dict(found) == top_k(items, 7, **rules)


def test_first_keeps_all_sources_apart(items, df):
    """Sources may be other rows than candidates."""
    sources = df.where("id % 5 = 1")
    found = exact_top_k(sources, df, 300)
    wanted = top_k(items, 300, sources={i["id"] for i in items if i["id"] % 5 == 1})
    assert as_dict(found) == wanted


def test_more_tiles_than_tasks(items, df, monkeypatch):
    monkeypatch.setattr("kindred.operators.similarity.MAX_TASKS", 3)
    assert as_dict(exact_top_k(df, df, 5, block_rows=40)) == top_k(items, 5)


def test_score_chunks(items, df, monkeypatch):
    import pyarrow as pa

    rows = [dict(i, is_source=s, key=None) for s in (True, False) for i in items]
    schema = pa.schema([("is_source", pa.bool_()), ("id", pa.int64()), ("vec", pa.list_(pa.float32())),
                        ("file", pa.string()), ("title", pa.string()), ("key", pa.binary())])
    tile = pa.Table.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)
    whole = kernel.score_tile(tile, 5, Rules(dedup="none"))
    monkeypatch.setattr(kernel, "CHUNK_ELEMENTS", 500)
    assert kernel.score_tile(tile, 5, Rules(dedup="none")).equals(whole)


def test_mixed_dimensions_are_rejected(spark):
    mixed = frame(spark, [dict(id=i, file=f"{i}", title=None, authors=[], vec=[1.0] * (i + 1)) for i in range(3)])
    with pytest.raises(Exception, match="dimension"):
        exact_top_k(mixed, mixed, 1).collect()


def test_limit_must_be_positive(df):
    with pytest.raises(ValueError):
        exact_top_k(df, df, 0)


def test_block_counts_bound_both_sides():
    rows, cols = block_counts(1_000_000, 50_000, 20_000, 16)
    assert 1_000_000 / rows <= 20_000 and 50_000 / cols <= 20_000
    assert block_counts(10, 10, 20_000, 16) == (1, 1)


def overfetched(items, limit, n):
    raw = top_k(items, overfetch(limit, n), same_file=False, same_title=False, dedup="none")
    by_id = {i["id"]: i for i in items}
    found, seen, ranks = {}, set(), {}
    for (s, c), (score, _) in sorted(raw.items(), key=lambda x: (x[0][0], x[1][1])):
        a, b = by_id[s], by_id[c]
        key = (s, b["title"], tuple(sorted(b["authors"])))
        if (a["file"] is not None and a["file"] == b["file"]) or (
            a["title"] is not None and a["title"] == b["title"]
        ):
            continue
        if key in seen:
            continue
        seen.add(key)
        ranks[s] = ranks.get(s, 0) + 1
        if ranks[s] <= limit:
            found[s, c] = (score, ranks[s])
    return found


def test_overfetch_may_leave_short_lists(items, df, monkeypatch):
    monkeypatch.setattr("kindred.operators.similarity.overfetch", lambda limit, n: 11)
    monkeypatch.setitem(globals(), "overfetch", lambda limit, n: 11)
    wanted = overfetched(items, 10, 0)
    assert as_dict(top_k_overfetched(df, df, 10)) == wanted
    assert min(sum(1 for s, _ in wanted if s == i["id"]) for i in items if i["id"] not in (30, 31)) < 10


@pytest.fixture(scope="module")
def index(df, tmp_path_factory):
    return CellIndex.build(df, str(tmp_path_factory.mktemp("index") / "i"), cells=5)


@pytest.mark.parametrize("few", [True, False])
def test_all_cells_is_exact(items, df, index, few):
    found = cell_top_k(df, index, 7, nprobe=5, block_rows=15, few=few)
    assert as_dict(found) == top_k(items, 7)


def test_too_many_sources_to_travel(df, index, monkeypatch):
    monkeypatch.setattr("kindred.operators.similarity.FEW_SOURCES", 3)
    for search in (lambda: exact_top_k(df, df, 2, few=True), lambda: cell_top_k(df, index, 2, few=True)):
        with pytest.raises(ValueError):
            search()


def test_probing_fewer_cells_finds_most(items, df, index):
    exact = top_k(items, 5)
    near = as_dict(cell_top_k(df, index, 5, nprobe=3))
    assert len(set(exact) & set(near)) > 0.6 * len(exact)


def test_index_covers_every_vector_and_reloads(spark, items, df, index, tmp_path):
    assert index.n == len(items) - 2 and index.items.count() == index.n
    path = str(tmp_path / "again")
    first = CellIndex.build(df, path, cells=3)
    again = CellIndex.build(df, path, cells=4)  # replaces the older one
    assert (first.cells, again.cells) == (3, 4)
    assert np.allclose(CellIndex.load(spark, path).centroids, again.centroids)


def test_index_checks(spark, df, index, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        CellIndex.build(df.limit(0))
    with pytest.raises(FileNotFoundError):
        CellIndex.load(spark, str(tmp_path / "nothing"))
    spark.range(3).write.parquet(str(tmp_path / "other" / "cells"))
    with pytest.raises(Exception):
        CellIndex.load(spark, str(tmp_path / "other"))
    wrong = df.withColumn("vec", F.slice("vec", 1, 3))
    with pytest.raises(ValueError, match="dimension"):
        cell_top_k(wrong, index, 3)


def test_library_items_need_a_vector(spark):
    books = spark.createDataFrame(
        [(1, "1.fb2", "T", "A, B"), (2, "2.fb2", "U", None), (3, "3.fb2", "V", "")],
        "id long, book string, title string, author string",
    )
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (9, [1.0, 1.0])],
                                    "book_id long, embedding array<float>")
    assert [(r.id, r.authors) for r in library_items(books, vectors).collect()] == [(1, ["A", "B"])]


STEP = Steps(np.array([-0.5, 0.1, 0.6]), np.array([0.2, 0.9, 0.9, 0.1]))
MIXED = Steps(np.array([-0.2, 0.3]), np.array([-0.4, -0.2, 0.5]))


def by_steps(steps):
    return lambda x: float(steps.values[int((steps.edges < x).sum())])


@pytest.mark.parametrize("steps", [STEP, MIXED], ids=["positive", "mixed"])
@pytest.mark.parametrize("dedup", ["none", "best", "first"])
def test_exact_reranks_all_candidates(items, df, steps, dedup):
    found = exact_top_k_rescored(df, df, 7, steps, Rules(dedup=dedup), block_rows=60)
    assert as_dict(found) == top_k(items, 7, dedup=dedup, predict=by_steps(steps))


def test_fallback_when_no_prediction_is_usable(spark, items):
    """Sources that meet only low predictions keep their similarities, others do not."""
    few = [dict(i) for i in items[:6]]
    for i, vec in enumerate([[1, 0], [0.9, 0.1], [-1, 0.1], [-0.8, -0.6], [0, 1], [0.2, -1]]):
        few[i].update(vec=np.float32(vec).tolist(), title=None, file=f"{i}", authors=[str(i)])
    steps = Steps(np.array([0.9]), np.array([-0.3, 0.7]))
    df = frame(spark, few)
    found = exact_top_k_rescored(df, df, 3, steps)
    assert as_dict(found) == top_k(few, 3, predict=by_steps(steps))
    assert as_dict(exact_top_k_rescored(df, df, 3, Steps(np.array([]), np.array([-1.0])))) == top_k(few, 3)
    assert as_dict(exact_top_k_rescored(df, df, 3, None)) == top_k(few, 3)


def test_rescore_lists(spark):
    lists = spark.createDataFrame(
        [(1, 2, 0.9), (1, 3, 0.2), (1, 4, 0.3), (5, 6, -0.9), (5, 7, -0.95)],
        "book_id long, similar_book_id long, score double",
    )
    steps = Steps(np.array([-0.8, 0.5]), np.array([-1.0, 0.8, 0.1]))
    rows = rescore(lists, steps, 2).orderBy("book_id", "rank").collect()
    assert [(r.similar_book_id, r.score, r.similarity) for r in rows] == [
        (4, 0.8, 0.3), (3, 0.8, 0.2), (6, -0.9, -0.9), (7, -0.95, -0.95)
    ]
    same = rescore(lists, None, 2).where("book_id = 1").orderBy("rank").collect()
    assert [r.similar_book_id for r in same] == [2, 4]


def test_search_modes(items, df, index):
    with pytest.raises(ValueError, match="mode"):
        search("other", df, df, 3)
    with pytest.raises(ValueError, match="index"):
        search("ann", df, df, 3)
    for mode in ("ann", "bounded"):
        found = search(mode, df, df, 3, index=index, nprobe=5)
        assert as_dict(found) == top_k(items, 3)
        found = search(mode, df, df, 3, index=index, nprobe=5, steps=STEP)
        assert as_dict(found) == top_k(items, 3, predict=by_steps(STEP))


def test_pool_keeps_more_than_the_limit(df, index):
    pool = neighbour_pool(df, df, 3)
    assert pool.groupBy("book_id").count().agg(F.max("count")).first()[0] > 3


def shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_no_lists_are_shuffled(df):
    """Only vectors move: neither pools nor lists go through a window or another shuffle."""
    for found in (top_k_overfetched(df, df, 10), exact_top_k(df, df, 10), exact_top_k(df, df, 10, Rules(same_title=False, dedup="none"))):
        plan = shuffles(found)
        assert "Window" not in plan and "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_blocks_are_bounded_by_the_places_of_their_lists():
    assert blocks.block_count(1_000_000, 400, 12) >= 1_000_000 * 400 / blocks.BLOCK_PLACES
    assert blocks.block_count(1_000_000, 10, 12) == 1_000_000 / blocks.BLOCK_SOURCES
    assert blocks.block_count(100_000, 10, 12) == 12 and blocks.block_count(10, 10, 12) == 1


def test_self_search_moves_each_vector_once_a_block(spark, df, monkeypatch):
    """As many copies of a vector as there are blocks, and one more; a grid had one a row and one a column."""
    monkeypatch.setattr(blocks, "MIN_SOURCES", 20)
    held = df.select("id", "vec").withColumn("key", F.lit(None).cast("binary"))
    assert self_blocks(held, 9).count() == 10 * held.count()
    asked = exact_top_k(df, df, 3, Rules(same_title=False, dedup="none"))
    assert asked.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_found_pairs_of_a_task_are_bounded(items, monkeypatch):
    """While lists are short every pair is a found pair: few of them are held before they are merged."""
    import pyarrow as pa

    monkeypatch.setattr(blocks, "SCORES", 800)
    monkeypatch.setattr(blocks, "WAITING", 50)
    held = []
    merge = blocks.Lists._merge
    monkeypatch.setattr(blocks.Lists, "_merge", lambda self: (held.append(self.waiting), merge(self)))
    some = [dict(id=i["id"], vec=i["vec"], key=None) for i in items]
    table = pa.Table.from_pylist(some, pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float32())), ("key", pa.binary())]))
    lists = blocks.Lists(table.slice(0, 40), 3, Rules(same_file=False, same_title=False, dedup="none"))
    lists.look(table)
    rows = pa.Table.from_batches(lists.rows(None))
    wanted = top_k(items, 3, same_file=False, same_title=False, dedup="none", sources=set(range(40)))
    assert {(r["book_id"], r["similar_book_id"]): (r["score"], r["rank"]) for r in rows.to_pylist()} == wanted
    assert max(held) <= 50 + max(240, 800 // 8)


def test_candidates_are_staged_and_not_shuffled(spark, tmp_path, monkeypatch):
    """blocks read the candidates from the shared folder, whatever their number; in a store that only Spark reads they are dealt."""
    from kindred.operators import similarity

    rng = np.random.default_rng(3)
    rows = [(i, f"{i}.fb2", f"t{i % 40}", ["a"], rng.normal(size=8).tolist()) for i in range(300)]
    items = spark.createDataFrame(rows, "id long, file string, title string, authors array<string>, vec array<float>")
    dealt_rows = []
    deal = similarity.dealt
    monkeypatch.setattr(similarity, "dealt", lambda rows, *a: (dealt_rows.append(rows.count()), deal(rows, *a))[1])
    read = sorted(map(tuple, exact_top_k(items, items, 5, block_rows=50).collect()))
    assert dealt_rows == [300]
    monkeypatch.setattr(blocks.Stored, "of", staticmethod(lambda table: None))
    assert sorted(map(tuple, exact_top_k(items, items, 5, block_rows=50).collect())) == read
    assert dealt_rows[1] > 6 * 300


def test_steps_that_lie_apart_leave_few_pairs_to_double_precision():
    """a pair is scored exactly only if its own step can reach the list, not if it lies between steps that can."""
    rng = np.random.default_rng(4)
    levels = rng.permutation(40)
    rules = Rules(same_file=False, same_title=False, dedup="none", step_edges=tuple(np.linspace(-0.6, 0.6, 39).tolist()), step_levels=tuple(levels.tolist()))
    passing = blocks._Passing(rules)
    scores = rng.uniform(-1, 1, 50_000)
    ranked = kernel.leveled(scores, rules)
    assert (passing.best(scores.astype(np.float32), 1e-5) >= ranked).all()
    floor = np.full(len(scores), 36 * kernel.LEVEL_SPAN)
    low, high = passing.range(floor)
    between = (scores >= low) & (scores <= high)
    close = between & (passing.best(scores, 1e-5) >= floor)
    assert close[ranked >= floor].all() and close.sum() < between.sum() / 3


def test_new_edges_are_searched_once(spark, monkeypatch):
    """rows and books of the new edges come from one search."""
    import __spark_entry__ as entry
    from kindred import session

    staged = []
    monkeypatch.setattr(entry, "stage", lambda rows, name: (staged.append(name), session.stage(rows, name))[1])
    entry.edge_replace(spark, "/root/testdata/sf0.001")
    assert staged == ["new-edges"]


def test_many_files_are_not_shuffled_to_spread_them(spark, tmp_path):
    """documents in as many files as there are tasks are read where they lie."""
    from kindred.plans.stand_ins import spread

    tasks = spark.sparkContext.defaultParallelism
    for files, moved in ((tasks, False), (1, tasks > 1)):
        spark.range(100).repartition(files).write.parquet(str(tmp_path / str(files)))
        held = spread(spark.read.parquet(str(tmp_path / str(files))))
        assert ("Exchange" in held._jdf.queryExecution().executedPlan().toString()) == moved
        assert held.count() == 100


def test_view_of_edges_shuffles_them_for_their_rank_rating_and_candidate_only(spark):
    """F16: lists leave the search ranked, and a view joins the candidates' names alone."""
    from kindred.operators.edges import ranked_view
    from kindred.schemas import BOOKS, FEEDBACK

    items = spark.createDataFrame(make_items(60), SCHEMA)
    found = search("exact", items, items, 3)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select("book_id", "similar_book_id", "score", "rank").collect())) == sorted(map(tuple, exact_top_k(items, items, 3).collect()))
    books, feedback = spark.createDataFrame([], BOOKS), spark.createDataFrame([], FEEDBACK)
    view = ranked_view(found.select("book_id", "similar_book_id", "score"), books, feedback, 3, "http://lib")
    assert view._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2
