"""What the operators share: input tables, batches of text, hashing, and connected components.

Every operator takes a DataFrame and the names of its columns, picks those columns at once, and so
never meets another column of the caller's. Work that several steps read is written to the folder
named by ``spark.checkpoint.dir`` and read again, so a lost executor costs only its own tasks.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.session import release, shared_dir, ship, stage

__all__ = ["table", "staged", "lean", "spans_of_text", "pieces", "mix", "slice_codes", "same_slices", "components", "shared_dir", "fold", "release"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(rows: DataFrame, name: str) -> DataFrame:
    return stage(rows, f"llm-{name}")


@cache
def _trim() -> Callable:
    """What makes the C library return free memory; nothing where it has no such call."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda keep: None


def give_back() -> None:
    """Return memory that Arrow and the C library hold but no object uses to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run: Callable) -> Callable:
    """The function of a `mapInArrow`, giving memory back after each batch and at its end. Python workers
    serve task after task, and their allocators would else keep the most that any task needed."""

    def tidy(batches):
        def fed():
            for batch in batches:
                yield batch
                del batch
                give_back()

        try:
            yield from run(fed())
        finally:
            give_back()

    return tidy


def fold(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; the fold of a null id is null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def spans_of_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row starts in them (one more entry than
    rows). Null is empty. No copy is made but for columns that hold null with bytes behind it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Slices beyond so many bytes are hashed and compared one by one.
LONG = 64
#: What to keep of eight bytes when only so many belong to the slice.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
STEP = np.uint64(0xD6E8FEB86659FD93)


def _eights(held: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on, as one number; zeros follow the end."""
    padded = np.concatenate([held, np.zeros(8, np.uint8)])
    return np.ndarray(len(held) + 1, "<u8", padded, strides=(1,))


def slice_codes(held: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice of the bytes.

    Eight bytes at a time go through a mixing of all bits, so that no two slices are equal because of how
    their bytes are arranged (as sums of powers of a base are modulo 2^64); those of one size up to eight
    bytes never are. Long slices are digested one by one.
    """
    sizes = ends - starts
    code = mix(sizes.astype(np.uint64) * STEP + np.uint64(1))
    eights, live, k = _eights(held), np.flatnonzero((sizes <= LONG) & (sizes > 0)), 0
    while len(live):
        left = sizes[live] - k
        code[live] = mix((code[live] ^ (eights[starts[live] + k] & KEEP[np.minimum(left, 8)])) * STEP)
        live, k = live[left > 8], k + 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        digest = hashlib.blake2b(held[starts[i] : ends[i]].data, digest_size=8).digest()
        code[i] = int.from_bytes(digest, "little")
    return code


def same_slices(held: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``starts`` and from ``others`` are equal over ``sizes`` bytes."""
    same = np.ones(len(starts), bool)
    eights, live, k = _eights(held), np.flatnonzero((sizes <= LONG) & (sizes > 0) & (starts != others)), 0
    while len(live):
        left = sizes[live] - k
        same[live] &= ((eights[starts[live] + k] ^ eights[others[live] + k]) & KEEP[np.minimum(left, 8)]) == 0
        live, k = live[left > 8], k + 8
    for i in np.flatnonzero((sizes > LONG) & (starts != others)).tolist():
        same[i] = np.array_equal(held[starts[i] : starts[i] + sizes[i]], held[others[i] : others[i] + sizes[i]])
    return same


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between ids, as (node, component): the smallest id each node reaches.

    Labels fall along links and are then looked up at the label itself, which halves the remaining
    depth in every round; a round is two aggregations over the links, cut by a staged table. A hub
    with many links is only ever aggregated or joined, never gathered in one group. Ends when no
    label falls. Links that hold null are left out; a node linked only with itself stays itself.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = staged(links.where("a < b").distinct(), "links")
    labels = None
    while True:
        # Hook: each link goes to the labels of its ends; contracted links shrink every round.
        if links.isEmpty():
            break
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to"))
        # Follow the pointers to a root: a node that points to itself.
        low = staged(low, "pointers")
        while True:
            up = low.select(F.col("node").alias("to"), F.col("to").alias("upper"))
            nxt = staged(low.join(up, "to").select("node", F.col("upper").alias("to"), (F.col("upper") != F.col("to")).alias("moved")), "pointers")
            low = nxt.select("node", "to")
            if nxt.where("moved").isEmpty():
                break
        if labels is None:
            labels = low.select("node", F.col("to").alias("component"))
        else:
            up = low.select(F.col("node").alias("component"), "to")
            # Contracted links join nodes of the first round only, so no node is new.
            labels = labels.join(up, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = staged(labels, "labels")
        at_a = low.select(F.col("node").alias("a"), F.col("to").alias("x"))
        at_b = low.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = links.join(at_a, "a").join(at_b, "b")
        links = staged(
            links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(),
            "links",
        )
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
