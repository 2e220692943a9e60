"""Scoring of one bounded tile: some sources against some candidates.

Runs inside Spark tasks (``applyInArrow`` / ``mapInArrow``). Spark decides which rows meet
in a tile and merges the tiles' short lists; this module only multiplies, excludes and keeps
the best ``limit`` candidates of every source.

Tile rows have columns ``is_source, id, vec, key`` and, as far as the rules ask for them,
``file, title, authors``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Scores are rounded before they are ranked, so that equal vectors tie whatever the
# order in which a matrix product summed them up; ties go to the lower candidate id.
SCORE_DIGITS = 9
MARGIN = 10.0**-SCORE_DIGITS

# Elements of one score matrix held at a time (8 bytes each).
CHUNK_ELEMENTS = 4_000_000

MIN_NORM = 1e-9

RESULT_SCHEMA = pa.schema(
    [
        ("book_id", pa.int64()),
        ("similar_book_id", pa.int64()),
        ("score", pa.float64()),
        ("key", pa.binary()),
        ("excluded", pa.bool_()),
    ]
)
RESULT_DDL = (
    "book_id long, similar_book_id long, score double, key binary, excluded boolean"
)


@dataclass(frozen=True)
class Rules:
    """What may not be returned, and which of several equal candidates stands for all.

    ``dedup``: "best" keeps the best scored candidate per key, "first" the lowest id,
    "none" keeps all. With ``flag_only`` excluded candidates stay in the list, marked.
    """

    same_file: bool = True
    same_title: bool = True
    same_author: bool = False
    dedup: str = "best"
    flag_only: bool = False
    # A step function of the similarity to rank by before the similarity itself: its edges,
    # and the place of each step's value among the distinct values, lowest first.
    step_edges: tuple[float, ...] | None = None
    step_levels: tuple[int, ...] = ()


# Similarities lie within -1..1, so this much apart the levels of a step function keep order.
LEVEL_SPAN = 4.0


def leveled(scores: np.ndarray, rules: "Rules") -> np.ndarray:
    """One number that ranks by (level of the step function, similarity)."""
    if rules.step_edges is None:
        return scores
    scores = np.round(scores, SCORE_DIGITS)
    at = np.searchsorted(np.array(rules.step_edges), scores, "left")
    return np.array(rules.step_levels, dtype=np.float64)[at] * LEVEL_SPAN + scores


def unit_rows(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """List column -> (unit vectors in double precision, mask of rows that have a direction)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0)), np.zeros(0, dtype=bool)
    sizes = pc.min_max(pc.list_value_length(column)).as_py()
    if column.null_count or sizes["min"] != sizes["max"]:
        raise ValueError("vectors of one table must share one dimension")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    vecs = flat.reshape(n, -1).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", vecs, vecs))
    valid = norms >= MIN_NORM
    return vecs / np.where(valid, norms, 1.0)[:, None], valid


def score_tile(tile: pa.Table, limit: int, rules: Rules) -> pa.Table:
    """Best candidates of every source of the tile, as ``RESULT_SCHEMA`` rows."""
    vecs, valid = unit_rows(tile["vec"])
    is_source = tile["is_source"].to_numpy(zero_copy_only=False).astype(bool)
    src = np.flatnonzero(is_source & valid)
    cand = np.flatnonzero(~is_source & valid)
    if not len(src) or not len(cand):
        return RESULT_SCHEMA.empty_table()

    ids = tile["id"].to_numpy()
    # Candidates of one key lie side by side, lowest id first.
    keys = np.arange(tile.num_rows) if rules.dedup == "none" else _codes(tile["key"])
    cand = cand[np.lexsort((ids[cand], keys[cand]))]
    starts = np.flatnonzero(np.r_[True, np.diff(keys[cand]) != 0])
    exclusions = _Exclusions(tile, src, cand, rules)

    out = []
    step = max(1, CHUNK_ELEMENTS // len(cand))
    for at in range(0, len(src), step):
        rows = np.arange(at, min(at + step, len(src)))
        scores = leveled(vecs[src[rows]] @ vecs[cand].T, rules)
        if not rules.flag_only:
            for i, row in enumerate(rows):
                for columns in exclusions.of(row):
                    scores[i, columns] = -np.inf
        r, c, s = _short_list(scores, starts, ids[cand], limit, rules.dedup)
        excluded = np.zeros(len(r), dtype=bool)
        if rules.flag_only:
            excluded = exclusions.mark(rows[r], c)
        out.append((ids[src[rows[r]]], ids[cand[c]], s, cand[c], excluded))
    book, similar, score, position, excluded = (np.concatenate(x) for x in zip(*out))
    return pa.table(
        [book, similar, score, tile["key"].take(pa.array(position)).combine_chunks(), excluded],
        schema=RESULT_SCHEMA,
    )


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Whole-number code per value; null is one value like the others."""
    encoded = column.combine_chunks().dictionary_encode()
    return pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False)


class _Exclusions:
    """Candidate columns each source may not see, found by value, not by comparing pairs."""

    def __init__(self, tile: pa.Table, src: np.ndarray, cand: np.ndarray, rules: Rules):
        self._parts = []
        for wanted, name in ((rules.same_file, "file"), (rules.same_title, "title")):
            if wanted:
                self._add_scalar(_codes(tile[name]), src, cand)
        if rules.same_author:
            self._add_lists(tile["authors"], src, cand)

    def _add_scalar(self, codes: np.ndarray, src: np.ndarray, cand: np.ndarray) -> None:
        order = np.argsort(codes[cand], kind="stable")
        ordered = codes[cand][order]
        wanted = codes[src]
        lo = np.searchsorted(ordered, wanted, "left")
        hi = np.searchsorted(ordered, wanted, "right")
        hi = np.where(wanted < 0, lo, hi)  # a null on the source side excludes nothing
        self._parts.append(lambda row: [order[lo[row] : hi[row]]])

    def _add_lists(self, column: pa.ChunkedArray, src: np.ndarray, cand: np.ndarray) -> None:
        lists = column.combine_chunks()
        owner = pc.list_parent_indices(lists).to_numpy()
        name = _codes(pa.chunked_array([lists.flatten()]))
        column_of = np.full(len(lists), -1)
        column_of[cand] = np.arange(len(cand))
        held = column_of[owner] >= 0
        order = np.argsort(name[held], kind="stable")
        names, columns = name[held][order], column_of[owner[held]][order]
        by_owner = np.searchsorted(owner, np.c_[src, src + 1])

        def of(row: int) -> list[np.ndarray]:
            found = []
            for code in name[by_owner[row, 0] : by_owner[row, 1]]:
                lo, hi = np.searchsorted(names, [code, code + 1])
                found.append(columns[lo:hi])
            return found

        self._parts.append(of)

    def of(self, row: int) -> list[np.ndarray]:
        return [columns for part in self._parts for columns in part(row)]

    def mark(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Which of the given (row, column) pairs are excluded; rows come sorted."""
        marked = np.zeros(len(rows), dtype=bool)
        for row in np.unique(rows):
            lo, hi = np.searchsorted(rows, [row, row + 1])
            for hidden in self.of(row):
                marked[lo:hi] |= np.isin(columns[lo:hi], hidden)
        return marked


def _short_list(
    scores: np.ndarray, starts: np.ndarray, ids: np.ndarray, limit: int, dedup: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the best ``limit`` keys of every row, best first."""
    n_rows, n_cols = scores.shape
    sizes = np.diff(np.r_[starts, n_cols])
    single = len(starts) == n_cols
    if single:
        best = scores
    elif dedup == "first":
        column = np.where(scores > -np.inf, np.arange(n_cols)[None, :], n_cols)
        first = np.minimum.reduceat(column, starts, axis=1)
        padded = np.concatenate([scores, np.full((n_rows, 1), -np.inf)], axis=1)
        best = np.take_along_axis(padded, first, axis=1)
    else:
        best = np.maximum.reduceat(scores, starts, axis=1)

    rows, groups = np.nonzero(_contenders(best, limit))
    if single:
        columns, found = groups, best[rows, groups]
    elif dedup == "first":
        columns, found = first[rows, groups], best[rows, groups]
    else:
        columns, found = _best_columns(scores, best, starts, sizes, rows, groups)

    found = np.round(found, SCORE_DIGITS)
    order = np.lexsort((ids[columns], -found, rows))
    rows, columns, found = rows[order], columns[order], found[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    kept = place < limit
    return rows[kept], columns[kept], found[kept]


def _contenders(best: np.ndarray, limit: int) -> np.ndarray:
    """Mask that covers at least the best ``limit`` keys of every row."""
    n = best.shape[1]
    mask = best > -np.inf
    if n > limit:
        # The limit-th best of some of the keys is a lower bound for that of all keys.
        probe = best[:, : max(8 * limit, n // 4)]
        m = probe.shape[1]
        bound = np.partition(probe, m - limit, axis=1)[:, m - limit]
        mask &= best >= (bound - 2 * MARGIN)[:, None]
    return mask


def _best_columns(scores, best, starts, sizes, rows, groups):
    """For chosen (row, key) pairs: lowest-id column among those with the best rounded score."""
    if not len(rows):
        return groups, best[rows, groups]
    lengths = sizes[groups]
    offsets = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    within = np.arange(total) - np.repeat(offsets, lengths)
    row = np.repeat(rows, lengths)
    column = np.repeat(starts[groups], lengths) + within
    top = np.round(best[rows, groups], SCORE_DIGITS)
    is_top = np.round(scores[row, column], SCORE_DIGITS) >= np.repeat(top, lengths)
    lowest = np.minimum.reduceat(np.where(is_top, column, scores.shape[1]), offsets)
    return lowest, top


def shorten(lists: pa.Table, limit: int, dedup: str) -> pa.Table:
    """Merge short lists within a task: best per (source, key), then the best ``limit``."""
    order = [("book_id", "ascending"), ("score", "descending"), ("similar_book_id", "ascending")]
    lists = lists.sort_by(order).combine_chunks()
    book = lists["book_id"].to_numpy()
    if dedup == "best" and len(book):
        keys = _codes(lists["key"])
        seen = np.lexsort((np.arange(len(book)), keys, book))
        first = np.r_[True, (np.diff(keys[seen]) != 0) | (np.diff(book[seen]) != 0)]
        lists = lists.take(pa.array(np.sort(seen[first])))
        book = lists["book_id"].to_numpy()
    place = np.arange(len(book)) - np.searchsorted(book, book, "left")
    return lists.filter(pa.array(place < limit))
