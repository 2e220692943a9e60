"""Byte-level BPE encoding and decoding.

Pre-tokens are found without a regular expression. Every codepoint gets a class (letter, number,
white space, other) from a table, and with it a transition on the state "where the current run
began": codepoints of the class before them keep the state, others set it to their own place. Keep
and set compose associatively (set after anything is set, keep after anything is that), so the
states of all codepoints of many texts are one prefix scan, a running maximum. What remains of the
pattern looks at most three codepoints around a run's edge: a space joins the run after it, white
space before it stays apart, and an apostrophe may open a contraction. The slices go to a cache of
merged pieces; the offsets of each token are kept for decoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.common import lean, mix, pieces, same_slices, slice_codes, spans_of_text

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Bytes of the texts that are scanned at once, and entries of a worker's cache of pieces.
CHUNK_BYTES = 1 << 20
CACHE_ENTRIES = 400_000
#: Fixed values of the pre-token pattern: white space and contractions.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
#: Letters and numbers of Unicode 16, which the tokenizer's tables have and Python's may lack.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every codepoint."""
    of = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    found[WHITE] = SPACE
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            found[first : last + 1] = kind
    return found


def boundaries(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the codepoints of several texts; ``starts`` has the texts' places.

    ``codes`` is not empty; ``starts`` holds no place twice and none at the end.
    """
    n = len(codes)
    kind = classes()[codes]
    opens = np.empty(n, bool)  # the transition sets the state
    opens[0] = True
    np.not_equal(kind[1:], kind[:-1], out=opens[1:])
    opens[starts] = True
    edges = np.flatnonzero(opens)
    lengths = np.diff(edges, append=n)
    run_kind = kind[edges]
    # Runs of white space with a run of the same text after them give up their last codepoint.
    ends_text = np.zeros(n + 1, bool)
    ends_text[starts] = True
    ends_text[n] = True
    last = edges + lengths - 1
    white = (run_kind == SPACE) & ~ends_text[edges + lengths]
    cut = np.zeros(n + 1, bool)
    cut[edges] = True
    long = white & (lengths > 1)
    cut[last[long]] = True
    glued = white & (codes[last] == 0x20)  # the space goes with the run after it
    cut[edges[glued] + lengths[glued]] = False
    # A lone apostrophe that starts a pre-token may open a contraction with the letters after it.
    lone = edges[(run_kind == OTHER) & (lengths == 1) & (codes[edges] == 0x27)]
    lone = lone[cut[lone] & ~ends_text[lone + 1]]
    if len(lone):
        ahead = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = ahead[lone + 1], ahead[lone + 2]
        short = np.isin(one, [ord(c) for c in ONE_LETTER])
        whole = ~ends_text[np.minimum(lone + 2, n)]
        pair = np.zeros(len(lone), bool)
        for a, b in TWO_LETTERS:
            pair |= (one == ord(a)) & (two == ord(b)) & whole
        cut[lone[short | pair] + 1] = False
        cut[lone[short] + 2] = True
        cut[lone[pair & ~short] + 3] = True
    return np.flatnonzero(cut[:n])


@lru_cache(4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: the pair of least rank, leftmost first, is merged until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 256:
        return _merge_long(parts, ranks)
    get, none = ranks.get, len(ranks)
    pair = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i] += parts.pop(i + 1)
        pair.pop(i)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
    return tuple(ranks[p] for p in parts)


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same for a long piece: a heap of pairs over a linked list."""
    import heapq

    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or len(parts[i]) + len(parts[j]) != size or ranks.get(parts[i] + parts[j]) != rank:
            continue
        parts[i] += parts[j]
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return tuple(ranks[parts[i]] for i in range(n) if alive[i])


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and at least n powers of an odd base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[1]) < n:
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(n, base), np.full(n, inverse)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        _powers[:] = [mix(np.arange(1, 257, dtype=np.uint64)), up, down]
    return _powers[0], _powers[1], _powers[2]


class Chunk:
    """Pre-tokens of rows ``first`` to ``last``: the distinct ones, and which of them stands where.

    ``words`` are the distinct slices as bytes, ``which`` has the number of each slice's word,
    ``at`` the byte where it starts, and row r has the slices from ``rows[r - first]`` to the next.
    Slices are grouped by a 64-bit hash, and each is compared with the slice that stands for its group;
    should two texts ever share a hash, all slices of the chunk are told apart by their bytes.
    Every ``special`` string in a text is one slice, and the text on either side is cut apart from it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int, special: tuple[bytes, ...] = ()):
        self.first, self.last = first, last
        held = data[offsets[first] : offsets[last]]
        raw = held.tobytes()
        heads = np.flatnonzero((held & 0xC0) != 0x80)  # bytes that begin a character
        begin = np.searchsorted(heads, offsets[first : last + 1] - offsets[first])
        if not len(heads):
            self.words, self.which, self.at = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.rows = np.zeros(last - first + 1, np.int64)
            return
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        opens = begin[:-1][begin[:-1] < len(codes)]
        spans = self._special(raw, offsets[first : last + 1] - offsets[first], special)
        if spans:
            edges = np.searchsorted(heads, np.array(spans))
            opens = np.concatenate([opens, edges[edges < len(codes)]])
        found = boundaries(codes, np.unique(opens))
        if spans:
            inside = np.searchsorted(edges[:, 0], found) > np.searchsorted(edges[:, 1], found, side="right")
            found = found[~inside]
        self.rows = np.searchsorted(found, begin)
        self.at = heads[found]
        ends = np.append(self.at[1:], len(raw))
        _, place, self.which = np.unique(slice_codes(held, self.at, ends), return_index=True, return_inverse=True)
        sizes = ends - self.at
        stands = place[self.which]
        if (sizes == sizes[stands]).all() and same_slices(held, self.at, self.at[stands], sizes).all():
            self.words = [raw[a:b] for a, b in zip(self.at[place].tolist(), ends[place].tolist(), strict=True)]
        else:
            number: dict[bytes, int] = {}
            every = (raw[a:b] for a, b in zip(self.at.tolist(), ends.tolist(), strict=True))
            self.which = np.array([number.setdefault(word, len(number)) for word in every], np.int64)
            self.words = list(number)

    @staticmethod
    def _special(raw: bytes, begin: np.ndarray, special: tuple[bytes, ...]) -> list[tuple[int, int]]:
        """Spans of the special strings in the texts that begin at ``begin``, leftmost first."""
        if not any(word in raw for word in special):
            return []
        pattern = re.compile(b"|".join(re.escape(word) for word in sorted(special, key=len, reverse=True)))
        rows = zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)
        return [m.span() for a, b in rows for m in pattern.finditer(raw, a, b)]

    def ids(self, cache) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices in order, and where each slice's begin (one more entry)."""
        known = list(map(cache.__getitem__, self.words))
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter(chain.from_iterable(known), np.int64, int(sizes.sum()))
        heads = np.cumsum(sizes) - sizes
        each = sizes[self.which]
        edges = np.concatenate([[0], np.cumsum(each)])
        place = np.repeat(heads[self.which] - edges[:-1], each) + np.arange(edges[-1])
        return flat[place], edges


def chunks(texts: pa.Array, special: tuple[bytes, ...] = ()) -> Iterator[Chunk]:
    """The pre-tokens of a column of texts, some rows at a time."""
    data, offsets = spans_of_text(texts)
    for first, last in pieces(offsets, CHUNK_BYTES):
        yield Chunk(data, offsets, first, last, special)


class Pieces(dict):
    """Ids by pre-token; filled as pre-tokens are met, emptied when full."""

    def __init__(self, encode_piece):
        self.encode_piece = encode_piece

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self[piece] = self.encode_piece(piece)
        return found


class Codec:
    """Encodes and decodes with the ranks of a file; one per Python worker."""

    def __init__(self, path: str):
        self.ranks = ranks_of(path)
        self.pieces = Pieces(lambda piece: merge(piece, self.ranks))
        most = max(self.ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * most
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.names = [str(rank) for rank in range(most)]
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, most)

    def ids(self, text: str) -> list[int]:
        """The ids of one text."""
        found = [c.ids(self.pieces)[0] for c in chunks(pa.array([text], pa.string()))]
        return np.concatenate(found).tolist() if found else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, starts): token ids of every row's text, and the byte where each token starts.

    Null text is empty and has no tokens; rows that repeat are each encoded; texts hold no special
    tokens, their strings are ordinary text. ``path`` is a rank file that every worker can open.
    """

    def run(batches):
        made = codec(path)
        for batch in batches:
            ids, starts = [], []
            for c in chunks(batch.column(1)):
                flat, edges = c.ids(made.pieces)
                sizes = made.sizes[flat]
                places = np.cumsum(sizes) - sizes
                for a, b in zip(edges[c.rows[:-1]], edges[c.rows[1:]], strict=True):
                    ids.append(flat[a:b])
                    starts.append(places[a:b] - places[a] if b > a else places[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64()))],
                ["id", "ids", "starts"],
            )

    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(lean(run), "id long, ids array<int>, starts array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text bytes) of rows (id, ids)."""

    def run(batches):
        made = codec(path)
        for batch in batches:
            found = [made.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "data"])

    return encoded.select("id", "ids").mapInArrow(lean(run), "id long, data binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces): digests of the ids of every text and
    of the bytes decoded from them, without the ids leaving their task. Rules as in `encode`; no
    tokens give the digest of the empty string."""

    def run(batches):
        made = codec(path)
        sha = hashlib.sha256
        for batch in batches:
            tokens, parts, coded, decoded = [], [], [], []
            for c in chunks(batch.column(1)):
                flat, edges = c.ids(made.pieces)
                flat = flat.tolist()
                for lo, hi in zip(c.rows[:-1], c.rows[1:], strict=True):
                    ids = flat[edges[lo] : edges[hi]]
                    tokens.append(len(ids))
                    parts.append(hi - lo)
                    coded.append(sha(" ".join(map(made.names.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(sha(made.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string()), pa.array(parts, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_pieces"],
            )

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long")
