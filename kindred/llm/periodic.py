"""Periodic runs of words, by Baier's grouping.

A run is a stretch of words that repeats with a period and cannot be made longer. Its root, the part
that repeats, is under one of two opposite orders of the words a Lyndon word, and the longest one
that starts where it does. The first phase of Baier's suffix sorter gives just these lengths: it
groups suffixes by their first word, and, from the highest group down, moves the suffixes that stand
before those of a group into groups of their own, whose common prefix grows by the group's; when a
group's turn comes, its prefix is the longest Lyndon word that its suffixes start with. Roots that
repeat are then extended to both sides by longest common extensions into runs.

Every sequence of a few words in a run recurs one period away, so only stretches of a text whose short
sequences all recur are sorted; most texts have none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.common import STEP, lean, mix, spans_of_text

#: Words that are compared first when a run is extended; each time after that twice as many.
AHEAD = 64
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lyndon_lengths(x: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place of ``x`` (whole numbers from 0 to their
    number of kinds); the end is less than all else."""
    n = len(x)
    kinds = sorted(set(x))
    number = {word: k for k, word in enumerate(kinds)}
    group = [0, *map(number.__getitem__, x)]  # of the suffix from each place, counted from 1
    members: list[list[int]] = [[] for _ in kinds]
    for i in range(1, n + 1):
        members[group[i]].append(i)
    prefix = [1] * len(kinds)
    below, above = list(range(-1, len(kinds) - 1)), list(range(1, len(kinds) + 1))
    found = [0] * (n + 1)
    left = list(range(n + 1))  # the nearest place to the left, itself included, whose group is yet to come
    at = len(kinds) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = []
        size = prefix[at]
        for i in own:
            found[i] = size
            left[i] = i - 1
        times: dict[int, int] = {}
        for i in own:
            j = left[i]
            while left[j] != j:
                left[j] = j = left[left[j]]
            left[i] = j
            if j:
                times[j] = times.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, many in times.items():
            moved.setdefault((many, group[j]), []).append(j)
        for many, old in sorted(moved, reverse=True):
            suffixes = moved[many, old]
            new = len(prefix)
            for j in suffixes:
                group[j] = new
            members.append(suffixes)
            prefix.append(prefix[old] + many * size)
            over = above[old]
            below.append(old)
            above.append(over)
            above[old] = new
            if over < len(below) and over != new:
                below[over] = new
        at = below[at]
    return found[1:]


def common(x: np.ndarray, i: int, j: int) -> int:
    """How many words from i and from j on (i < j) are equal."""
    done, step = 0, AHEAD
    while j + done < len(x):
        there = x[j + done : j + done + step]
        apart = np.flatnonzero(x[i + done : i + done + len(there)] != there)
        if len(apart):
            return done + int(apart[0])
        done, step = done + len(there), 2 * step
    return done


def extended(x: np.ndarray, lengths: np.ndarray, least: int, times: int, found: set[tuple[int, int, int]]) -> None:
    """Add the runs (start, length, period) whose roots are Lyndon words of the given lengths."""
    n = len(x)
    roots = 2 if times > 2 else 1  # whole roots in succession that such a run holds at least
    place = np.flatnonzero(np.arange(n) + roots * lengths <= n - (roots < 2))
    period = lengths[place]
    same = np.ones(len(place), bool)
    if roots == 2:  # cheap looks at a few words of both
        same = lengths[place + period] == period
        for inside in (np.zeros(len(period), np.int64), period - 1, period // 2):
            same &= x[place + inside] == x[place + inside + period]
    back = x[::-1]
    reach: dict[int, int] = {}  # end of the last run of a period
    for i, p in zip(place[same].tolist(), period[same].tolist(), strict=True):
        if i + roots * p <= reach.get(p, 0):
            continue
        ahead = common(x, i, i + p)
        behind = common(back, n - i - p, n - i) if i and ahead + p >= (roots - 1) * 2 * p else 0
        start, end = i - behind, i + p + ahead
        if end - start >= 2 * p:
            reach[p] = end
        if end - start >= max(least, times * p):
            found.add((start, end - start, p))


def recurring(x: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches (start, end) outside of which there is no run of ``least`` words or more and ``times`` periods
    or more: in such a run every sequence of ``least * (times - 2) // times + 1`` words recurs."""
    wide, most = 1, least * (times - 2) // times + 1
    code = mix(x.astype(np.uint64) + np.uint64(1))
    while 2 * wide <= most and len(code) > wide:
        code = mix(code[:-wide] * STEP + code[wide:])
        wide *= 2
    order = np.argsort(code, kind="stable")
    equal = code[order[1:]] == code[order[:-1]]
    again = np.zeros(len(code) + 2, np.int8)
    again[order[1:][equal] + 1] = 1
    again[order[:-1][equal] + 1] = 1
    edges = np.flatnonzero(np.diff(again))
    starts, ends = edges[::2], edges[1::2] + wide - 1
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def runs(x: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``x`` of at least ``least`` words and ``times`` periods, by start and
    period; ``times`` is 2 or more."""
    found: set[tuple[int, int, int]] = set()
    if len(x) < max(least, 2):
        return []
    for start, end in recurring(x, least, times):
        _, own = np.unique(x[start:end], return_inverse=True)
        inside: set[tuple[int, int, int]] = set()
        for order in (own, own.max() - own):
            extended(own, np.array(lyndon_lengths(order.tolist()), np.int64), least, times, inside)
        found.update((start + a, length, period) for a, length, period in inside)
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays when every run keeps only its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


Places = Callable[[int | None, int], np.ndarray | None]


def periodic_runs(
    docs: DataFrame, least: int = 24, times: int = 3, places: Places | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: the runs (start, length, period) of its words by start
    and period, and the words with all but the first period of each run left out, joined by blanks.

    Words are runs without ASCII white space, told apart by their bytes. Null, empty and blank texts have
    no words and no runs. Rows that repeat are each searched. ``places`` may give, for an id and a number of
    words, which word of the text to read at each place (None: as they stand).
    """

    def run(batches):
        for batch in batches:
            data, offsets = spans_of_text(batch.column(1))
            ids = batch.column(0).to_pylist()
            made: list[list] = [[] for _ in range(3)]
            for r, doc in enumerate(ids):
                words = data[offsets[r] : offsets[r + 1]].tobytes().split()
                n = len(words)
                at = places(doc, n) if places else None
                number = {word: k for k, word in enumerate(dict.fromkeys(words))}
                x = np.fromiter(map(number.__getitem__, words), np.int64, n)
                if at is not None:
                    x = x[at]
                found = runs(x, least, times)
                if at is not None or found:
                    stays = np.flatnonzero(kept(n, found))
                    words = map(words.__getitem__, (stays if at is None else at[stays]).tolist())
                for column, value in zip(made, (n, found, b" ".join(words)), strict=True):
                    column.append(value)
            sizes = np.cumsum([0, *map(len, made[1])])
            flat = np.array([triple for own in made[1] for triple in own], np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            columns = [batch.column(0), pa.array(made[0], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)]
            columns.append(pa.array(made[2], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(lean(run), f"doc_id long, n_words long, runs {RUNS}, collapsed string")
