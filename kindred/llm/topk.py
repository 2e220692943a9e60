"""Exact top-k by inner product over multi-resolution segment statistics.

Vectors are whole numbers, ``floor(scale * x)``. A vector is cut into segments, and of each the
mean and the deviation are kept, at several resolutions. Between two vectors the squared distance
is at least the sum over segments of length times (difference of means squared plus difference of
deviations squared); with the vectors' norms that bounds their inner product from above. Candidates go
from the coarsest resolution to the finest, each time only those whose bound reaches the query's
k-th best score so far; the inner product is computed for what survives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import lean, staged
from kindred.llm.vectors import usable
from kindred.session import parallelism

#: Queries that are answered together, candidates that are compared at once, segments by resolution.
QUERIES, BLOCK = 4096, 2048
SEGMENTS = (4, 8, 16)
NONE = np.iinfo(np.int64).max
#: Largest product of two sums that doubles hold exactly.
EXACT = float(1 << 53)


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, each times the root of the segment's length."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    sizes = np.diff(edges).astype(float)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    means = sums / sizes
    deviations = np.sqrt(np.maximum(squares / sizes - means * means, 0.0))
    return means * np.sqrt(sizes), deviations * np.sqrt(sizes)


class Best:
    """The k best (score, smallest id) of each query so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.norms = (x * x).sum(1)
        self.levels = [statistics(x, s) for s in SEGMENTS]
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), NONE)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        norms = (x * x).sum(1)
        q = c = None
        for (means, deviations), own in zip(self.levels, (statistics(x, s) for s in SEGMENTS), strict=True):
            # Distance at least: |a|^2 + |b|^2 - 2 (means . means + deviations . deviations).
            floor = self.scores[:, -1]
            if q is None:
                near = means @ own[0].T + deviations @ own[1].T
                distance = self.norms[:, None] + norms[None, :] - 2 * near
                bound = (self.norms[:, None] + norms[None, :] - distance) / 2
                slack = 1e-9 * (self.norms[:, None] + norms[None, :]) + 1e-6
                q, c = np.nonzero(bound + slack >= floor[:, None])
            else:
                keep = np.empty(len(q), bool)
                for a in range(0, len(q), 1 << 18):
                    i, j = q[a : a + (1 << 18)], c[a : a + (1 << 18)]
                    near = np.einsum("ij,ij->i", means[i], own[0][j]) + np.einsum("ij,ij->i", deviations[i], own[1][j])
                    keep[a : a + (1 << 18)] = near + 1e-9 * (self.norms[i] + norms[j]) + 1e-6 >= floor[i]
                q, c = q[keep], c[keep]
        other = self.ids[q] != ids[c]
        q, c = q[other], c[other]
        exact = np.empty(len(q))
        for a in range(0, len(q), 1 << 18):
            i, j = q[a : a + (1 << 18)], c[a : a + (1 << 18)]
            exact[a : a + (1 << 18)] = np.einsum("ij,ij->i", self.x[i], x[j])
        keep = exact >= self.scores[q, -1]
        q, c, exact = q[keep], c[keep], exact[keep]
        if not len(q):
            return
        # The new ones and those kept, best first; the first k of each query stay.
        rows = np.concatenate([np.repeat(np.arange(len(self.ids)), self.k), q])
        scores = np.concatenate([self.scores.ravel(), exact])
        named = np.concatenate([self.found.ravel(), ids[c]])
        order = np.lexsort((named, -scores, rows))
        rows, scores, named = rows[order], scores[order], named[order]
        begin = np.searchsorted(rows, np.arange(len(self.ids)))
        take = begin[:, None] + np.arange(self.k)
        self.scores, self.found = scores[take], named[take]


def whole(column: pa.Array, scale: float):
    for rows, x in usable(column):
        yield rows, np.floor(scale * x)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of highest inner product with each query, ties to
    the smaller id, a query's own id left out.

    Both tables have the same columns. Vectors that are null, have no components, or hold null or
    non-finite ones take no part, nor do rows without an id; vectors of different lengths are not compared.
    Rows that repeat an id count once, as the one that is least in order. Scores are exact up to 2^53.
    """

    def clean(rows: DataFrame) -> DataFrame:
        picked = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].cast("array<double>").alias("x"))
        return picked.where("id IS NOT NULL").groupBy("id").agg(F.min("x").alias("x"))

    asked = staged(clean(queries), "queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    lanes = parallelism(vectors.sparkSession)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    lane = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(lanes)).cast("int")
    # A query goes to every lane, a candidate to every block of queries in its own lane.
    a = asked.select("id", "x", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"))
    b = clean(vectors).select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), lane.alias("lane"), F.lit(1).alias("kind"))
    b = staged(b, "candidates")
    rows = a.unionAll(b).repartition(max(lanes, parallelism(vectors.sparkSession)), "block", "lane")

    def run(batches):
        key, held, best = None, {}, {}

        def flush():
            queries_, ranks, found, scores = [], [], [], []
            for own in best.values():
                real = own.found != NONE
                i, r = np.nonzero(real)
                queries_.append(own.ids[i])
                ranks.append(r)
                found.append(own.found[real])
                scores.append(own.scores[real].astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (queries_, found, scores)], ["query_id", "vec_id", "score"]
            )

        for batch in batches:
            place = batch.column(0).to_numpy() * np.int64(1 << 32) + batch.column(1).to_numpy()
            kinds, ids = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            edges = np.flatnonzero(np.diff(place * 2 + kinds, prepend=-1))
            for lo, hi in zip(edges, np.append(edges[1:], len(place)), strict=True):
                if place[lo] != key:
                    if best:
                        yield flush()
                    key, held, best = place[lo], {}, {}
                for at, x in whole(batch.column(4).slice(lo, hi - lo), scale):
                    own, size = ids[lo + at], x.shape[1]
                    if not kinds[lo]:
                        held.setdefault(size, []).append((own, x))
                        continue
                    if held:
                        best = {n: Best(np.concatenate([v[0] for v in part]), np.concatenate([v[1] for v in part]), k) for n, part in held.items()}
                        held = {}
                    if size in best:
                        for s in range(0, len(own), BLOCK):
                            best[size].add(own[s : s + BLOCK], x[s : s + BLOCK])
        if best:
            yield flush()

    ordered = rows.sortWithinPartitions("block", "lane", "kind").select("block", "lane", "kind", "id", "x")
    found = ordered.mapInArrow(lean(run), "query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
