"""Near-duplicate vectors by PCA-ordered tiles.

Vectors are turned to the principal axes of all of them, the axis of most variance first, sorted
along it and cut into blocks. Two blocks are compared only if their boxes on the leading axes come
within the distance that the threshold allows. In a tile the products of the leading axes are summed
first; the rest of a cosine is at most the product of the two suffix norms, so a pair is given up as
soon as both together stay below the threshold. Survivors are decided on the vectors themselves.
Blocks are written once, some to a file, and a task reads the two files whose blocks it compares: no
block is shuffled for each block that it meets.
Equal vectors are compared once, with their number. A tile returns link counts and a
spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from kindred import stored
from kindred.llm.common import components, lean, staged
from kindred.llm.vectors import usable
from kindred.session import parallelism

#: Vectors of a block, blocks of a file or shuffled together to one they meet, axes of the boxes, and the axes
#: summed by the end of each step.
BLOCK, STRIP, BOX = 2048, 8, 8
STEPS = (8, 16, 32)
#: Numbers that a step of a comparison holds at once, whatever the length of the vectors.
CELLS = 1 << 19
#: Numbers of the blocks that a task keeps made ready while it goes through two files.
READY = 8 << 20
SLACK = 1e-9


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _moments(vectors: DataFrame) -> DataFrame:
    """(size, cell, total): sums of the products of components of the unit vectors, by length."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in usable(batch.column(0)):
                norms = np.linalg.norm(x, axis=1)
                ok = np.isfinite(norms) & (norms > 0)
                u = x[ok] / norms[ok, None]
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + u.T @ u
        for size, m in sums.items():
            n = size * size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size)), pa.array(np.arange(n)), pa.array(m.ravel())], ["size", "cell", "total"])

    return vectors.select("x").mapInArrow(lean(run), "size long, cell long, total double").groupBy("size", "cell").agg(F.sum("total").alias("total"))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by length of vector, as columns, most variance first. Only sums of products,
    (length of a vector)^2 numbers, come to the driver."""
    rows = _moments(vectors).toPandas()
    found = {}
    for size, own in rows.groupby("size"):
        m = np.zeros(size * size)
        m[own["cell"].to_numpy()] = own["total"].to_numpy()
        found[int(size)] = np.linalg.eigh(m.reshape(size, size))[1][:, ::-1].copy()
    return found


def _digested(vectors: DataFrame) -> DataFrame:
    """(id, one, two, ok): whether a vector can link, and a digest of its components."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            ok, halves = np.zeros(n, bool), np.zeros((n, 2), np.int64)
            for rows, x in usable(batch.column(1)):
                norms = np.linalg.norm(x, axis=1)
                ok[rows] = np.isfinite(norms) & (norms > 0)
                for r, v in zip(rows, x + 0.0, strict=True):  # -0.0 is 0.0
                    halves[r] = np.frombuffer(hashlib.blake2b(v.tobytes(), digest_size=16).digest(), np.int64)
            ok &= np.asarray(batch.column(0).is_valid())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ok)], ["id", "one", "two", "ok"])

    return vectors.select("id", "x").mapInArrow(lean(run), "id long, one long, two long, ok boolean")


def _blocks(rows: DataFrame, turned: dict[int, np.ndarray], most: int, kind: str) -> DataFrame:
    """(block, size, ids, many, data, low, high) of rows (id, many, x), sorted along the first axis.
    The components lie in ``data`` as numbers of that kind."""

    def first_axis(batches):
        for batch in batches:
            at = np.zeros(batch.num_rows)
            for rows_, x in usable(batch.column(2)):
                at[rows_] = (x / np.linalg.norm(x, axis=1)[:, None]) @ turned[x.shape[1]][:, 0]
            size = pa.compute.list_value_length(batch.column(2)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, pa.array(at)], ["id", "many", "x", "size", "at"])

    def cut(batches):
        held: dict[int, list] = {}

        def made(size, parts):
            ids, many, x = (np.concatenate([p[i] for p in parts]) for i in range(3))
            y = (x / np.linalg.norm(x, axis=1)[:, None]) @ turned[size][:, : min(BOX, size)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(ids[0])]), pa.array([size]), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([many.tolist()], pa.list_(pa.int64())),
                    pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([y.min(0).tolist()], pa.list_(pa.float64())), pa.array([y.max(0).tolist()], pa.list_(pa.float64())),
                ],
                ["block", "size", "ids", "many", "data", "low", "high"],
            )

        for batch in batches:
            ids, many = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows_, x in usable(batch.column(2)):
                size = x.shape[1]
                for s in range(0, len(rows_), most):
                    part = rows_[s : s + most]
                    parts = held.setdefault(size, [])
                    if parts and sum(len(p[0]) for p in parts) + len(part) > most:
                        yield made(size, held.pop(size))
                        parts = held.setdefault(size, [])
                    parts.append((ids[part], many[part], x[s : s + most]))
        for size, parts in held.items():
            yield made(size, parts)

    placed = rows.select("id", "many", "x").mapInArrow(lean(first_axis), "id long, many long, x array<double>, size long, at double")
    placed = staged(placed, "placed")
    n = parallelism(rows.sparkSession)
    ordered = placed.repartitionByRange(n, "size", "at", "id").sortWithinPartitions("size", "at", "id")
    schema = "block long, size long, ids array<long>, many array<long>, data binary, low array<double>, high array<double>"
    # A file has few blocks, so that who needs one does not read many.
    path = stored.written(ordered.select("id", "many", "x").mapInArrow(lean(cut), schema), "llm-blocks", most=STRIP)
    return rows.sparkSession.read.schema(schema).parquet(path)


class Side:
    """A block in a tile: unit vectors, their places on the axes and the norms of what follows each step."""

    def __init__(self, size: int, ids, many, data: bytes, turned: np.ndarray, kind: str):
        self.ids, self.many = np.array(ids, np.int64), np.array(many, np.int64)
        self.x = np.frombuffer(data, kind).reshape(-1, size).astype(np.float64)
        self.norms = np.linalg.norm(self.x, axis=1)
        self.y = (self.x / self.norms[:, None]) @ turned
        squares = np.cumsum(self.y[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.after = {s: np.sqrt(squares[:, s]) for s in STEPS if s < size}


def linked(a: Side, b: Side, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) with a cosine of the threshold or more, a few rows of a at a time;
    in one block each pair once."""
    rows = max(1, CELLS // len(b.ids))
    for first in range(0, len(a.ids), rows):
        i, j = _linked_rows(a, b, threshold, first, min(first + rows, len(a.ids)), same)
        if len(i):
            yield i, j


def _linked_rows(a: Side, b: Side, threshold: float, first: int, last: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    size, steps = a.x.shape[1], [s for s in STEPS if s < a.x.shape[1]]
    done = steps[0] if steps else size
    sums = a.y[first:last, :done] @ b.y[:, :done].T
    after_a, after_b = (side.after.get(done, np.zeros(len(side.ids))) for side in (a, b))
    keep = sums + after_a[first:last, None] * after_b >= threshold - SLACK
    if same:
        keep = np.triu(keep, first + 1)
    i, j = np.nonzero(keep)
    part, i = sums[i, j], i + first
    for stop in steps[1:]:
        fits = np.zeros(len(i), bool)
        for at in _slices(len(i), stop - done):
            p, q = i[at], j[at]
            part[at] += np.einsum("ij,ij->i", a.y[p, done:stop], b.y[q, done:stop])
            fits[at] = part[at] + a.after[stop][p] * b.after[stop][q] >= threshold - SLACK
        i, j, part, done = i[fits], j[fits], part[fits], stop
    fits = np.zeros(len(i), bool)
    for at in _slices(len(i), size):
        p, q = i[at], j[at]
        fits[at] = np.einsum("ij,ij->i", a.x[p], b.x[q]) / (a.norms[p] * b.norms[q]) >= threshold
    return i[fits], j[fits]


def _slices(pairs: int, width: int) -> Iterator[slice]:
    """Slices of the pairs whose vectors of that width stay within ``CELLS`` numbers."""
    most = max(1, CELLS // width)
    return (slice(s, s + most) for s in range(0, pairs, most))


def spanning(forest: Forest, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs that join two trees of the forest. The first of each i and of each j go ahead; most
    others then lie in one tree and are left out at once."""
    lead = np.union1d(np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1])
    for pick in (lead, np.setdiff1d(np.arange(len(i)), lead, assume_unique=True)):
        roots = np.array([forest.root(x) for x in range(len(forest.up))])
        pick = pick[roots[i[pick]] != roots[j[pick]]]
        for p, q in zip(i[pick].tolist(), j[pick].tolist(), strict=True):
            if forest.join(p, q):
                yield p, q


LINKS = "id long, links long, other long"


class Met:
    """Link counts and a spanning forest of the links of a block with others."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def meet(self, a: Side, b: Side, threshold: float, same: bool) -> None:
        forest, shift = Forest(len(a.ids) + len(b.ids)), 0 if same else len(a.ids)
        both = np.concatenate([a.ids, b.ids])
        gained = np.zeros(len(both), np.int64)
        for i, j in linked(a, b, threshold, same):
            gained += np.bincount(i, weights=b.many[j], minlength=len(both)).astype(np.int64)
            gained += np.bincount(j + len(a.ids), weights=a.many[i], minlength=len(both)).astype(np.int64)
            for p, q in spanning(forest, i, j + shift):
                self.edges.append((int(both[p]), int(both[q])))
        for p in np.flatnonzero(gained).tolist():
            self.counts[int(both[p])] = self.counts.get(int(both[p]), 0) + int(gained[p])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.counts:
            ids = [*self.counts, *(e[0] for e in self.edges)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([*self.counts.values(), *[0] * len(self.edges)], pa.int64()),
                    pa.array([*[None] * len(self.counts), *(e[1] for e in self.edges)], pa.int64()),
                ],
                ["id", "links", "other"],
            )


class File:
    """The blocks of a file; those used last are kept ready."""

    def __init__(self, name: str, turned: dict[int, np.ndarray], number: str):
        self.turned, self.number, self.ready = turned, number, {}
        self.rows = {}
        for batch in stored.batches(name, ["block", "size", "ids", "many", "data"], 1):
            self.rows[batch.column(0)[0].as_py(), batch.column(1)[0].as_py()] = batch

    def side(self, block: int, size: int) -> Side:
        key = block, size
        if key not in self.ready:
            row = self.rows[key]
            ids, many = (row.column(c).flatten().to_numpy() for c in (2, 3))
            while self.ready and sum(2 * s.x.size for s in self.ready.values()) + 2 * len(ids) * size > READY:
                self.ready.pop(next(iter(self.ready)))
            self.ready[key] = Side(size, ids, many, row.column(4)[0].as_py(), self.turned[size], self.number)
        return self.ready[key]


def _met_in_files(pairs: DataFrame, blocks: DataFrame, turned: dict[int, np.ndarray], threshold: float, number: str) -> DataFrame:
    """(id, links, other) of the pairs of blocks: a task reads two files, and compares what of them meets."""
    at = blocks.select("block", "size", F.input_file_name().alias("file"))
    met = pairs.join(at, "block").join(at.select(F.col("block").alias("other"), "size", F.col("file").alias("file2")), ["other", "size"])
    tiles = met.groupBy("file", "file2").agg(F.sort_array(F.collect_list(F.struct("block", "other", "size"))).alias("pairs"))

    def run(batches):
        held: dict[str, File] = {}
        for batch in batches:
            for one, two, pairs_ in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held = {name: held.get(name) or File(name, turned, number) for name in dict.fromkeys((one, two))}
                met, last = Met(), None
                for p in pairs_:
                    if last is not None and last != p["block"]:
                        yield from met.rows()
                        met = Met()
                    last = p["block"]
                    a, b = held[one].side(p["block"], p["size"]), held[two].side(p["other"], p["size"])
                    met.meet(a, b, threshold, p["block"] == p["other"])
                yield from met.rows()

    # Many small partitions: tiles with many pairs do not lie together, those of one file do as far as they can.
    tasks = 4 * parallelism(pairs.sparkSession)
    ordered = tiles.repartitionByRange(tasks, "file", "file2").sortWithinPartitions("file", "file2")
    return ordered.select("file", "file2", "pairs").mapInArrow(lean(run), LINKS)


def _met_in_strips(pairs: DataFrame, blocks: DataFrame, turned: dict[int, np.ndarray], threshold: float, number: str) -> DataFrame:
    """The same where tasks cannot open the files: strips of blocks are shuffled to each block they meet."""
    strip = F.floor((F.row_number().over(Window.partitionBy("block").orderBy("other")) - 1) / STRIP)
    pairs = staged(pairs.withColumn("strip", strip), "tiles")
    data = blocks.select(F.col("block").alias("other"), "size", "ids", "many", "data")
    others = pairs.join(data, "other").withColumn("kind", F.lit(1))
    own = pairs.select("block", "strip").distinct().withColumn("other", F.col("block")).join(data, "other").withColumn("kind", F.lit(0))
    columns = ["block", "strip", "kind", "other", "size", "ids", "many", "data"]
    tiles = staged(own.select(columns), "own").unionAll(staged(others.select(columns), "others"))

    def run(batches):
        a, key, met = None, None, Met()
        for batch in batches:
            for r in range(batch.num_rows):
                block, strip_, kind, other, size, ids, many, data_ = (batch.column(c)[r].as_py() for c in range(8))
                side = Side(size, ids, many, data_, turned[size], number)
                if kind == 0:
                    yield from met.rows()
                    a, key, met = side, (block, strip_), Met()
                    continue
                assert key == (block, strip_)
                met.meet(a, side, threshold, other == block)
        yield from met.rows()

    ordered = tiles.repartition(parallelism(pairs.sparkSession), "block", "strip").sortWithinPartitions("block", "strip", "kind", "other")
    return ordered.select(columns).mapInArrow(lean(run), LINKS)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, zero, without components or with null or non-finite ones link with nothing,
    nor do rows without an id (their component is null, kept is true); vectors of different lengths do
    not link. Rows that repeat an id are one vector, the one that is least in order. The threshold is above 0.
    """
    given = vectors.schema[vector_col].dataType
    # Single-precision components travel as they came; all sums are in double.
    number = "f4" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "f8"
    every = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("x"))
    picked = every.where("id IS NOT NULL").groupBy("id").agg(F.min("x").alias("x"))
    rows = staged(_digested(picked), "vectors")
    good = rows.where("ok").select("id", "one", "two")
    classes = staged(good.groupBy("one", "two").agg(F.min("id").alias("rep"), F.count("*").alias("many")), "classes")
    turned = axes(picked)
    reps = picked.join(classes.select(F.col("rep").alias("id"), "many"), "id")
    blocks = _blocks(reps, turned, BLOCK, number)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    boxes = blocks.select("block", "size", "low", "high")
    slab = lambda c: F.floor(c / reach).cast("long") if reach else F.lit(0)
    left = boxes.withColumn("slab", F.explode(F.sequence(slab(F.col("low")[0] - reach), slab(F.col("high")[0] + reach))))
    right = boxes.select(
        F.col("block").alias("other"), "size", F.col("low").alias("low2"), F.col("high").alias("high2"),
        F.explode(F.sequence(slab(F.col("low")[0]), slab(F.col("high")[0]))).alias("slab"),
    )
    gap = F.aggregate(
        F.sequence(F.lit(0), F.size("low") - 1), F.lit(0.0),
        lambda s, k: s + F.pow(F.greatest(F.lit(0.0), F.col("low")[k] - F.col("high2")[k], F.col("low2")[k] - F.col("high")[k]), 2),
    )
    pairs = left.join(right, ["size", "slab"]).where("block <= other").where(gap <= reach * reach + SLACK)
    pairs = staged(pairs.select("block", "other").distinct(), "pairs")
    if blocks.isEmpty() or stored.readable(blocks.inputFiles()[0]):
        found = _met_in_files(pairs, blocks, turned, threshold, number)
    else:
        found = _met_in_strips(pairs, blocks, turned, threshold, number)
    found = staged(found, "links")
    links = found.where("other IS NULL").groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    linked_ = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = classes.join(links, "rep", "left").join(linked_.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(
        "one", "two", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("ok")
    )
    out = rows.join(classes, ["one", "two", "ok"], "left").select("id", "n_links", "component_id")
    out = every.select("id").join(out, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")
    )
