"""Word shingles of texts as 64-bit hashes, some rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kindred.llm.common import mix, pieces, slice_codes, spans_of_text

CHUNK_BYTES = 1 << 20
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that end a word: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, hash of every word, where each row's words begin in them): words are runs
    without white space, A-Z in lower case."""
    for first, last in pieces(offsets, CHUNK_BYTES):
        held = LOWER[data[offsets[first] : offsets[last]]]
        begin = offsets[first : last + 1] - offsets[first]
        n = len(held)
        inside = ~WHITE[held]
        opens = inside.copy()
        opens[1:] &= WHITE[held[:-1]]
        inner = begin[(begin > 0) & (begin < n)]
        opens[inner] = inside[inner]
        starts = np.flatnonzero(opens)
        closes = inside.copy()
        closes[:-1] &= WHITE[held[1:]]
        closes[inner - 1] = inside[inner - 1]
        ends = np.flatnonzero(closes) + 1
        yield first, last, slice_codes(held, starts, ends), np.searchsorted(starts, begin)


def shingles(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes by row, where each row's begin): the distinct runs of ``width`` words;
    a text with fewer words is one run, a text without words has none."""
    data, offsets = spans_of_text(texts)
    for first, last, code, begin in words(data, offsets):
        counts = np.diff(begin)
        row = np.repeat(np.arange(last - first), counts)
        n = len(code)
        left = begin[1:][row] - np.arange(n)  # words from here to the row's end
        made = np.zeros(n, np.uint64)
        size = np.minimum(counts, width)[row]
        for k in range(width):
            there = np.minimum(np.arange(n) + k, max(n - 1, 0))
            more = (left > k) & (k < size)
            made = np.where(more, (made + code[there] if n else made) * STEP, made)
        keep = (left >= width) | ((counts[row] < width) & (np.arange(n) == begin[:-1][row]))
        made, row = mix(made[keep] + size[keep].astype(np.uint64)), row[keep]
        order = np.lexsort((made, row))
        made, row = made[order], row[order]
        fresh = np.ones(len(made), bool)
        fresh[1:] = (made[1:] != made[:-1]) | (row[1:] != row[:-1])
        made, row = made[fresh], row[fresh]
        yield first, made, np.searchsorted(row, np.arange(last - first + 1))
