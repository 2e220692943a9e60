"""Exact top-k similarity: every source against every candidate.

Sources are dealt to blocks, one a task, and all candidates go by each block in pieces, which leaves
whole lists (``blocks``). Candidates are staged once and read by every block; only sources are shuffled, neither
candidates nor short lists nor pairs.
Where the lowest id stands for a title, sources and candidates are laid out as bounded tiles
instead, scored into short lists (``kernel``) that are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kindred.functions.text import author_list
from kindred.operators import kernel
from kindred.operators.blocks import BLOCK_SOURCES, Stored, block_count, dealt, listed
from kindred.operators.kernel import Rules
from kindred.session import parallelism, stage, union

# Rows per side of a tile: 20,000 x 384 doubles is 61 MB.
BLOCK_ROWS = 20_000
# Below this a tile is not worth its task.
MIN_BLOCK_ROWS = 256
# At most so many sources may travel to every task, where the caller asks for it.
FEW_SOURCES = 1_000

# Beyond so many tiles a task takes several, one after the other.
MAX_TASKS = 20_000

LIST_COLUMNS = ["book_id", "similar_book_id", "score", "rank"]


def dedup_key(title: Column, authors: Column) -> Column:
    """16 bytes that stand for (title, author set); null title is a value of its own."""
    names = F.array_sort(F.coalesce(authors, F.array().cast("array<string>")))
    return F.unhex(F.md5(F.to_json(F.struct(title.alias("t"), names.alias("a")))))


def library_items(books: DataFrame, vectors: DataFrame) -> DataFrame:
    """Books that have a vector, as ``id, file, title, authors, vec``."""
    vecs = vectors.where(F.col("embedding").isNotNull()).select(
        F.col("book_id").alias("id"), F.col("embedding").alias("vec")
    )
    names = books.select(
        "id", F.col("book").alias("file"), "title", author_list(F.col("author")).alias("authors")
    )
    return names.join(vecs, "id")


def overfetch(limit: int, n: int) -> int:
    """How many raw neighbours to take before exclusions thin them out."""
    return min(20 * limit + 200, n)


def exact_top_k(
    sources: DataFrame,
    candidates: DataFrame,
    limit: int,
    rules: Rules = Rules(),
    n_sources: int | None = None,
    n_candidates: int | None = None,
    block_rows: int = BLOCK_SOURCES,
    few: bool = False,
) -> DataFrame:
    """Best ``limit`` candidates of every source: ``book_id, similar_book_id, score, rank``.

    Both inputs are ``library_items``. Row counts may be given when they are known;
    otherwise they are counted, since they decide the blocks. ``few`` is for a query about some
    books: the sources, at most ``FEW_SOURCES`` of them, go to the candidates, of which then
    none is shuffled.
    """
    check_limit(limit)
    spark = candidates.sparkSession
    same = sources is candidates and rules.dedup != "first"
    if rules.dedup == "first":
        candidates = first_per_title(candidates)
    src, cand = tile_rows(sources, rules, True), tile_rows(candidates, rules, False)

    if few:
        if rules.dedup == "first":
            raise ValueError('the "first" rule needs all titles of a block together')
        lists = cand.mapInArrow(against(few_rows(src), limit, rules), kernel.RESULT_DDL)
        return merge_lists(lists, limit, rules)

    if rules.dedup != "first":
        lists = whole_lists(src, cand, same, n_sources, limit, rules, block_rows)
        return lists if rules.flag_only else lists.select(LIST_COLUMNS)
    n_src = sources.count() if n_sources is None else n_sources
    n_cand = candidates.count() if n_candidates is None else n_candidates
    rows, cols = block_counts(n_src, n_cand, min(block_rows, BLOCK_ROWS), 2 * parallelism(spark))
    # All rows of a title must meet in one tile when the lowest id stands for it.
    src = src.withColumn("row", _block("id", rows))
    src = src.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    cand = cand.withColumn("col", _block(F.coalesce(F.hex("key"), F.lit("")), cols))
    cand = cand.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    tiles = union(src, cand)
    tiles = tiles.withColumn("tile", (F.col("row") * cols + F.col("col")).cast("int")).drop(
        "row", "col"
    )
    # The tile number is the partition number, or its remainder: a tile never spreads over tasks.
    tiles = tiles.repartitionById(min(rows * cols, MAX_TASKS), "tile")
    return merge_lists(score_tiles(tiles, ["tile"], limit, rules), limit, rules)


def whole_lists(
    src: DataFrame,
    cand: DataFrame,
    same: bool,
    n_src: int | None,
    limit: int,
    rules: Rules,
    block_rows: int = BLOCK_SOURCES,
    final: int | None = None,
) -> DataFrame:
    """Lists of all sources against all candidates (``tile_rows``), block by block; ``final`` as in ``listed``.

    Candidates are written to the shared folder first. If tasks cannot read it, candidates are shuffled to every block.
    """
    cand = stage(cand, "candidates")
    if n_src is None:
        n_src = (cand if same else src).count()
    count = block_count(n_src, limit, cand.sparkSession.sparkContext.defaultParallelism, block_rows)
    stored = Stored.of(cand)
    if stored is not None:
        own = (cand.withColumn("is_source", F.lit(True)) if same else src).withColumn("block", _block("id", count))
        return listed(dealt(own, count, MAX_TASKS), limit, rules, final, stored=stored)
    if same:
        rows = self_blocks(cand, count)
    else:
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        rows = union(src.withColumn("block", _block("id", count)), cand.withColumn("block", everywhere))
    return listed(dealt(rows, count, MAX_TASKS), limit, rules, final)


def self_blocks(items: DataFrame, count: int) -> DataFrame:
    """Every item as a source of its block and as a candidate of every block, in one pass over the items."""

    def place(is_source: bool, block: Column) -> Column:
        return F.struct(F.lit(is_source).alias("is_source"), block.alias("block"))

    as_candidate = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: place(False, b))
    both = F.concat(F.array(place(True, _block("id", count))), as_candidate)
    return items.drop("is_source").select("*", F.inline(both))


def _block(of: Column | str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(blocks)).cast("int")


def neighbour_pool(
    sources: DataFrame,
    candidates: DataFrame,
    limit: int,
    rules: Rules = Rules(),
    n_candidates: int | None = None,
    search=exact_top_k,
    **search_options,
) -> DataFrame:
    """The nearest ``overfetch(limit, n)`` of every source, then excluded and deduplicated.

    A source whose neighbours are mostly excluded ends up with fewer than ``limit``; plain
    ``exact_top_k`` always fills up. ``candidates`` is what ``search`` searches.
    """
    n = candidates.count() if n_candidates is None else n_candidates
    pool = search(
        sources,
        candidates,
        overfetch(limit, n),
        replace(rules, flag_only=True),
        n_candidates=n,
        **search_options,
    )
    pool = pool.where(~F.col("excluded"))
    return best_per_key(pool) if rules.dedup == "best" else pool


def top_k_overfetched(
    sources: DataFrame, candidates: DataFrame, limit: int, rules: Rules = Rules(), n_candidates: int | None = None
) -> DataFrame:
    """``neighbour_pool`` of the exact search cut to the best ``limit``, in the task that finds it: pools are not shuffled."""
    check_limit(limit)
    if rules.dedup == "first":
        raise ValueError('the "first" rule needs all titles of a block together')
    same = sources is candidates
    n = candidates.count() if n_candidates is None else n_candidates
    n_src = n if same else None
    flagged = replace(rules, flag_only=True)
    src, cand = tile_rows(sources, flagged, True), tile_rows(candidates, flagged, False)
    pool = max(1, overfetch(limit, n))
    return whole_lists(src, cand, same, n_src, pool, flagged, final=limit).select(LIST_COLUMNS)


def check_limit(limit: int) -> None:
    if limit <= 0:
        raise ValueError("limit must be positive")


def tile_rows(items: DataFrame, rules: Rules, is_source: bool, *keep: str) -> DataFrame:
    """Items with only the columns the kernel needs under these rules."""
    columns = [F.lit(is_source).alias("is_source"), F.col("id"), F.col("vec")]
    if rules.same_file:
        columns.append(F.col("file"))
    if rules.same_title:
        columns.append(F.col("title"))
    if rules.same_author:
        columns.append(F.col("authors"))
    if is_source or (rules.dedup == "none" and not rules.flag_only):
        key = F.lit(None).cast("binary")
    elif rules.dedup == "first":
        key = F.unhex(F.md5("title"))
    else:
        key = dedup_key(F.col("title"), F.col("authors"))
    return items.select(*columns, key.alias("key"), *keep)


def few_rows(src: DataFrame) -> pa.Table:
    """The sources themselves; more than ``FEW_SOURCES`` are refused."""
    head = src.limit(FEW_SOURCES + 1).toArrow()
    if head.num_rows > FEW_SOURCES:
        raise ValueError(f"more than {FEW_SOURCES} sources: search without few")
    return head


def block_counts(n_src: int, n_cand: int, block_rows: int, wanted_tiles: int) -> tuple[int, int]:
    """Blocks per side: small enough for a task's memory, enough tiles for the cluster."""
    rows, cols = max(1, math.ceil(n_src / block_rows)), max(1, math.ceil(n_cand / block_rows))
    while rows * cols < wanted_tiles:
        per_row, per_col = n_src / rows, n_cand / cols
        if max(per_row, per_col) < 2 * MIN_BLOCK_ROWS:
            break
        if per_row >= per_col:
            rows *= 2
        else:
            cols *= 2
    return rows, cols


def score_tiles(tiles: DataFrame, by: list[str], limit: int, rules: Rules) -> DataFrame:
    rules = _in_tile(rules)
    return tiles.groupBy(*by).applyInArrow(
        lambda tile: kernel.score_tile(tile, limit, rules), kernel.RESULT_DDL
    )


def _in_tile(rules: Rules) -> Rules:
    """Flagged lists are raw neighbours: dedup comes later, on the merged list."""
    return replace(rules, dedup="none") if rules.flag_only else rules


def against(sources: pa.Table, limit: int, rules: Rules, by: str | None = None):
    """Task function: candidate batches against a few sources, one short list per task.

    With ``by``, sources and candidates meet only where that column is equal.
    """
    rules = _in_tile(rules)

    def tiles(batch: pa.Table) -> Iterator[pa.Table]:
        if by is None:
            yield pa.concat_tables([sources, batch])
            return
        for value in batch[by].unique():
            yield pa.concat_tables(
                [t.filter(pc.equal(t[by], value)) for t in (sources, batch)]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [kernel.RESULT_SCHEMA.empty_table()]
        for batch in batches:
            if batch.num_rows:
                rows = pa.table(batch).select(sources.column_names).cast(sources.schema)
                held += [kernel.score_tile(tile, limit, rules) for tile in tiles(rows)]
            if len(held) >= 16:
                held = [kernel.shorten(pa.concat_tables(held), limit, rules.dedup)]
        yield from kernel.shorten(pa.concat_tables(held), limit, rules.dedup).to_batches()

    return run


def merge_lists(lists: DataFrame, limit: int, rules: Rules) -> DataFrame:
    """Short lists of all tiles -> the final list of every source."""
    # One shuffle by source serves both windows. A source brings at most tiles x limit rows.
    lists = lists.repartition("book_id")
    if rules.flag_only:
        return cut(lists, limit)
    if rules.dedup == "best":
        lists = best_per_key(lists)
    return cut(lists, limit).select(LIST_COLUMNS)


def best_per_key(lists: DataFrame) -> DataFrame:
    w = W.partitionBy("book_id", "key").orderBy(F.desc("score"), "similar_book_id")
    return lists.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cut(lists: DataFrame, limit: int) -> DataFrame:
    """Top ``limit`` per source, ranked from 1."""
    w = W.partitionBy("book_id").orderBy(F.desc("score"), "similar_book_id")
    return lists.withColumn("rank", F.row_number().over(w).cast("long")).where(
        F.col("rank") <= limit
    )


def first_per_title(items: DataFrame) -> DataFrame:
    """Corpus for the "first" rule: the two lowest-id rows per title with different files.

    A source hides only its own file, so the lowest visible id of a title is always
    among these two. Both windows cut before their shuffle, so a hot title stays small.
    """
    per_file = W.partitionBy("title", "file").orderBy("id")
    per_title = W.partitionBy("title").orderBy("id")
    lowest = items.withColumn("_n", F.row_number().over(per_file)).where("_n = 1")
    return lowest.withColumn("_n", F.row_number().over(per_title)).where("_n <= 2").drop("_n")
