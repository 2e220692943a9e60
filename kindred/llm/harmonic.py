"""Harmonic packing of token sequences.

A document gives sequences of its own as long as it fills them, and one rest shorter than a
sequence. Rests fall into reciprocal classes: class k holds lengths above ``limit / (k + 1)`` and
up to ``limit / k``, so any k of them fit together. Rests are dealt to workers by a hash, and
every worker fills the sequences of every class with k rests each, knowing nothing of the others.

What the sequences of a class leave open is then filled with rests that are cut: those of the
longest classes, as many as the histogram of the classes calls for, and those a worker had left
over. Open places lie end to end on one axis, the rests to be cut on another; where the two are
laid over each other is where a rest is cut, one cut for an open place. What remains goes on in
full sequences, and the very last tokens in sequences whose sizes are powers of two, so that no
sequence needs padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.bpe import chunks
from kindred.llm.common import lean, staged
from kindred.llm.packing import pieces_of, special_of
from kindred.session import parallelism, union

#: Id after the last token of a document.
END = 1
#: Rests that one worker deals at most, about; sequences whose tokens lie in one stretch of the axis.
DEALT, STRETCH = 1 << 20, 512
#: Kinds of sequences, in the lowest bits of their numbers.
FULL, CLASS, CUT = 0, 1, 2


def tokenised(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, doc_tokens, place, crcs, rest, rest_crc, rest_ids) of every row of ``docs``: a number of its
    own, its tokens with the id that ends it, the checksums of its full pieces and the number of the
    first of them, and length, checksum and ids (unsigned, four bytes each) of its rest."""

    def run(batches):
        cache, special = pieces_of(path), tuple(special_of(path))
        base = TaskContext.get().partitionId() << 33
        row = place = base
        for batch in batches:
            made: list[list] = [[] for _ in range(7)]
            for c in chunks(batch.column(1), special):
                flat, edges = c.ids(cache)
                flat = flat.astype("<u4")
                for lo, hi in zip(c.rows[:-1], c.rows[1:], strict=True):
                    ids = np.append(flat[edges[lo] : edges[hi]], np.array([END], "<u4")).tobytes()
                    tokens = len(ids) // 4
                    whole = tokens // limit
                    crcs = [zlib.crc32(ids[4 * limit * k : 4 * limit * (k + 1)]) for k in range(whole)]
                    rest = ids[4 * limit * whole :]
                    for column, value in zip(made, (row, tokens, place, crcs, tokens % limit, zlib.crc32(rest), rest), strict=True):
                        column.append(value)
                    row, place = row + 1, place + whole
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(m, kind) for m, kind in zip(made, kinds, strict=True)]
            names = ["row", "doc_id", "doc_tokens", "place", "crcs", "rest", "rest_crc", "rest_ids"]
            yield pa.RecordBatch.from_arrays([columns[0], batch.column(0), *columns[1:]], names)

    schema = "row long, doc_id long, doc_tokens long, place long, crcs array<long>, rest long, rest_crc long, rest_ids binary"
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), schema)


def dealt(rests: DataFrame, limit: int, workers: int) -> DataFrame:
    """Rests with ``klass``, ``worker``, ``bin`` (their sequence among those of class and worker), ``at`` (the
    tokens before them in it) and ``filled``: whether the sequence has as many rests as its class asks for."""
    rows = rests.withColumn("klass", F.expr(f"{limit} div rest")).withColumn("worker", F.pmod(F.xxhash64("row"), F.lit(workers)))
    own = Window.partitionBy("klass", "worker")
    rows = rows.withColumn("bin", F.expr("(row_number() OVER (PARTITION BY klass, worker ORDER BY row) - 1) div klass"))
    rows = rows.withColumn("filled", F.count("*").over(own) >= (F.col("bin") + 1) * F.col("klass"))
    before = Window.partitionBy("klass", "worker", "bin").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.coalesce(F.sum("rest").over(before), F.lit(0)))


def kept_whole(classes: list[tuple[int, int, int]], limit: int, workers: int) -> tuple[int, int]:
    """(class, sequences) from (class, tokens, filled sequences): the rests of higher classes stay whole, and of
    this one those in so many sequences of each worker. What is left to cut is then no fewer tokens than
    these sequences leave open."""
    room = sum(own for _, own, _ in classes) // limit  # sequences that all tokens can fill
    for klass, _, filled in sorted(classes, reverse=True):
        if filled > room:
            return klass, room // workers
        room -= filled
    return 0, 0


def on_axis(rows: DataFrame, size: str, *key: str) -> DataFrame:
    """Rows with ``begin``: they lie end to end, each over ``size`` places, in an order by hash and key."""
    parts = 4 * parallelism(rows.sparkSession)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    sums = rows.groupBy("part").agg(F.sum(size).alias("own"))
    sums = sums.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.col("before") + F.sum(size).over(within) - F.col(size)
    return rows.join(F.broadcast(sums), "part").withColumn("begin", begin).drop("part", "before")


def overlaid(places: DataFrame, rests: DataFrame, end: int, limit: int) -> DataFrame:
    """(row, from, length, sequence_id, offset): the rests (row, begin, rest) cut where the open places (begin,
    open, sequence_id, offset) meet. Both cover the axis from 0 to ``end``, in stretches of their own."""
    width = limit * STRETCH

    def points(rows: DataFrame, size: str, name: str, other: str) -> DataFrame:
        ends = F.expr(f"(begin + {size} - 1) div {width}")
        kept = F.struct(*[c for c in rows.columns if c != size])
        cut = rows.where(F.col("begin") < end).select("begin", kept.alias(name), F.explode(F.sequence(F.expr(f"begin div {width}"), ends)).alias("stretch"))
        at = F.greatest(F.col("begin"), F.col("stretch") * width)
        blank = F.lit(None).cast("struct<begin:long,sequence_id:long,offset:long>" if other == "place" else "struct<row:long,begin:long>")
        return cut.select("stretch", at.alias("at"), name, blank.alias(other)).select("stretch", "at", "place", "piece")

    both = union(points(places.select("begin", "sequence_id", "offset", "open"), "open", "place", "piece"), points(rests.select("row", "begin", "rest"), "rest", "piece", "place"))
    by = Window.partitionBy("stretch").orderBy("at")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.least(F.lit(end), (F.col("stretch") + 1) * width)
    met = both.select(
        "at",
        F.last("place", ignorenulls=True).over(so_far).alias("place"),
        F.last("piece", ignorenulls=True).over(so_far).alias("piece"),
        (F.coalesce(F.lead("at").over(by), stop) - F.col("at")).alias("length"),
    ).where("length > 0")
    return met.select("piece.row", (F.col("at") - F.col("piece.begin")).alias("from"), "length", "place.sequence_id", (F.col("place.offset") + F.col("at") - F.col("place.begin")).alias("offset"))


def pack(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    Null text is empty, one token. Rows that repeat are documents of their own, rows without an id too.
    The string of a special token in a text is that token. No documents give no rows. A document is cut
    at multiples of ``limit``; its rest is whole but for the classes that fill open places.
    """
    spark = docs.sparkSession
    rows = staged(tokenised(docs, path, limit, id_col, text_col), "tokens")
    rests = rows.where("rest > 0")
    workers = max(2 * parallelism(spark), -(-rests.count() // DEALT))
    carried = rests.select("row", "doc_id", "doc_tokens", "rest", "rest_crc")
    own = staged(dealt(carried, limit, workers), "dealt")
    filled = F.sum(F.when(F.col("filled"), 1).otherwise(0))
    classes = own.groupBy("klass").agg(F.sum("rest").alias("tokens"), filled.alias("filled")).collect()  # at most `limit` rows
    klass, bins = kept_whole([(r.klass, r.tokens, r.filled // r.klass) for r in classes], limit, workers)
    own = own.withColumn("filled", F.col("filled") & ((F.col("klass") > klass) | ((F.col("klass") == klass) & (F.col("bin") < bins))))

    whole = own.where("filled")
    number = F.shiftleft((F.shiftleft(F.shiftleft("klass", 20) + F.col("worker"), 28) + F.col("bin")), 2) + CLASS
    whole = whole.withColumn("sequence_id", number)
    open_ = whole.groupBy("sequence_id").agg(F.sum("rest").alias("offset")).withColumn("open", limit - F.col("offset")).where("open > 0")
    to_cut = own.where(~F.col("filled")).select("row", "rest")
    places = on_axis(open_, "open", "sequence_id").select("begin", "open", "sequence_id", "offset")
    taken = open_.agg(F.coalesce(F.sum("open"), F.lit(0))).first()[0]
    end = to_cut.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    full, last = divmod(end - taken, limit)
    more = spark.range(full).select((F.col("id") * limit + taken).alias("begin"), F.lit(limit).cast("long").alias("open"), (F.shiftleft("id", 2) + CUT).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    tail, begin = [], end - last
    for bit in reversed(range(limit.bit_length())):
        if last >> bit & 1:
            tail.append((begin, 1 << bit, (full + len(tail) << 2) + CUT, 0))
            begin += 1 << bit
    places = union(union(places, more), spark.createDataFrame(tail, "begin long, open long, sequence_id long, offset long"))
    cuts = overlaid(places, on_axis(to_cut, "rest", "row"), end, limit)
    ids = rests.select("row", "doc_id", "doc_tokens", "rest", "rest_ids")
    cut = cuts.join(ids, "row").select(
        "doc_id",
        (F.col("doc_tokens") - F.col("rest") + F.col("from")).alias("start"),
        "length",
        F.crc32(F.expr("substring(rest_ids, int(4 * from + 1), int(4 * length))")).alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
    start = F.col("doc_tokens") - F.col("rest")
    kept = whole.select("doc_id", start.alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.col("at").alias("offset"))
    sequence = F.shiftleft(F.col("place") + F.col("k"), 2) + FULL
    each = rows.select("doc_id", "doc_tokens", "place", F.posexplode("crcs").alias("k", "ids_crc32"))
    each = each.select("doc_id", (F.col("k") * F.lit(limit).cast("long")).alias("start"), F.lit(limit).cast("long").alias("length"), "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return union(union(each, kept), cut)
