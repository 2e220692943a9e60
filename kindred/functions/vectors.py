"""Vector expressions over ``array<float>`` columns, and the blob codec."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

# Vectors shorter than this count as "no vector".
MIN_NORM = 1e-9


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    a, b = _col(a), _col(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column | str) -> Column:
    v = _col(v)
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def has_direction(v: Column | str) -> Column:
    """True for vectors that can be normalised (not null, not the zero vector)."""
    return F.coalesce(l2_norm(v) >= F.lit(MIN_NORM), F.lit(False))


def normalise(v: Column | str, zero_as_null: bool = True) -> Column:
    """Unit vector; a zero vector reads as null, or stays zero on the write side."""
    v = _col(v)
    # The norm goes in as a second array so that it is computed once per vector, not per element.
    unit = F.element_at(
        F.transform(
            F.array(l2_norm(v)),
            lambda n: F.when(
                n >= F.lit(MIN_NORM),
                F.transform(v, lambda x: (x.cast("double") / n).cast("float")),
            ),
        ),
        1,
    )
    if zero_as_null:
        return unit
    return F.coalesce(unit, F.transform(v, lambda x: F.lit(0.0).cast("float")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity for vectors of any length; null when either has no direction."""
    # One struct per pair, so that each norm is computed once.
    parts = F.struct(dot(a, b).alias("d"), l2_norm(a).alias("a"), l2_norm(b).alias("b"))
    return F.element_at(
        F.transform(
            F.array(parts),
            lambda p: F.when(
                (p["a"] >= F.lit(MIN_NORM)) & (p["b"] >= F.lit(MIN_NORM)),
                p["d"] / (p["a"] * p["b"]),
            ),
        ),
        1,
    )


@F.arrow_udf(ArrayType(FloatType()))
def decode_blob(blob: pa.Array) -> pa.Array:
    """Little-endian float32 bytes -> array: the bytes of a batch are read as they lie."""
    valid, offsets, values = _of_blobs(blob)
    return _lists(valid, offsets, values)


@F.arrow_udf(BinaryType())
def encode_blob(vec: pa.Array) -> pa.Array:
    """Array -> little-endian float32 bytes, batch at a time; a missing component is NaN."""
    return _blobs(*_of_lists(vec))


@F.arrow_udf(ArrayType(FloatType()))
def stored_vector(blob: pa.Array) -> pa.Array:
    """The vector of a stored blob, of length one; null for null and for one without a direction."""
    valid, offsets, values = _of_blobs(blob)
    unit, norms = _units(offsets, values)
    return _lists(valid & (norms >= MIN_NORM), offsets, unit)


@F.arrow_udf(BinaryType())
def vector_to_store(vec: pa.Array) -> pa.Array:
    """The blob of a vector, normalised; zeros for one without a direction."""
    valid, offsets, values = _of_lists(vec)
    return _blobs(valid, offsets, _units(offsets, values)[0])


def _units(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values divided by the norms of their rows (0 where there is no direction), and the norms."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = values.astype(np.float64)
    norms = np.sqrt(np.bincount(row, weights=wide * wide, minlength=len(offsets) - 1))
    by = np.where(norms >= MIN_NORM, norms, np.inf)
    return (wide / by[row]).astype("<f4"), norms


def _of_lists(vec: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vec = _whole(vec)
    sizes = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = vec.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False)
    return np.asarray(vec.is_valid()), offsets, flat.astype("<f4")


def _of_blobs(blob: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which blobs are there, where each begins in the values, and the values."""
    blob = _whole(blob)
    valid = np.asarray(blob.is_valid())
    blob = blob.fill_null(b"")
    if not len(blob):
        return valid, np.zeros(1, np.int64), np.zeros(0, "<f4")
    wide = pa.types.is_large_binary(blob.type)
    _, ends, data = blob.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if (ends % 4).any():
        raise ValueError("blobs must hold whole float32 values")
    return valid, ends // 4, np.frombuffer(held.tobytes(), "<f4")


def _lists(valid: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=pa.array(~valid))


def _blobs(valid: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    buffers = [pa.array(valid).buffers()[1], pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(values.tobytes())]
    return pa.BinaryArray.from_buffers(pa.binary(), len(valid), buffers)


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
