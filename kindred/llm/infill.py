"""Fill-in-the-middle transformation over seekable compressed texts.

A text is stored as independent zstandard frames of some ten thousand bytes, cut between units (a
word with the white space before it), with the number of units before each frame. A cut at any unit
needs the one frame that holds it; all others go as they are from the text to its transformed
output, which is a list of frames again, and digests read frames one after the other. No step
holds more of a text unpacked than a frame.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import lean, spans_of_text

FRAME_BYTES = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The order of the parts in each form of output, each after its mark.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD_END = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
BLANKS = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")


@lru_cache(1)
def _codecs() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()


def packed(data: bytes) -> bytes:
    return _codecs()[0].compress(data)


def unpacked(frame: bytes) -> bytes:
    return _codecs()[1].decompress(frame)


def cut(raw: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a text of about ``most`` bytes with their numbers of units; no unit lies in two. A unit
    longer than that makes its part longer."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > most and (word := WORD_END.search(raw, at + most - 1)):
            end = word.end()
        part = raw[at:end]
        yield part, len(part.split()) + (part[-1] in BLANKS)
        at = end


STORED = "doc_id long, n long, before array<long>, chars array<long>, frames array<binary>, marked boolean"


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, before, chars, frames, marked) of every row: its text as frames, with the units before each
    and its codepoints; all its units; and whether it holds a mark. Null text is empty and has no frame."""
    marks = re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))).encode())

    def run(batches):
        for batch in batches:
            data, offsets = spans_of_text(batch.column(1))
            made: list[list] = [[] for _ in range(5)]
            for r in range(batch.num_rows):
                raw = data[offsets[r] : offsets[r + 1]].tobytes()
                n, before, chars, frames = 0, [], [], []
                for part, units in cut(raw, frame_bytes):
                    before.append(n)
                    chars.append(len(part.decode()))
                    frames.append(packed(part))
                    n += units
                for column, value in zip(made, (n, before, chars, frames, marks.search(raw) is not None), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.bool_())
            columns = [batch.column(0), *(pa.array(m, kind) for m, kind in zip(made, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "before", "chars", "frames", "marked"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(lean(run), STORED)


class Stored:
    """A stored text, of which frames are unpacked as they are needed."""

    def __init__(self, n: int, before: list[int], chars: list[int], frames: list[bytes]):
        self.n, self.before, self.chars, self.frames = n, before, chars, frames

    def seek(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, codepoints of the text before) where a unit begins."""
        if unit >= self.n:
            return len(self.frames), 0, sum(self.chars)
        k = bisect_right(self.before, unit) - 1
        skip = unit - self.before[k]
        if not skip:
            return k, 0, sum(self.chars[:k])
        raw = unpacked(self.frames[k])
        at = next(islice(UNIT.finditer(raw), skip - 1, None)).end()
        return k, at, sum(self.chars[:k]) + len(raw[:at].decode())

    def between(self, start: tuple[int, int, int], end: tuple[int, int, int]) -> list[bytes]:
        """Frames of the text from one place to another; only those that are cut are packed anew."""
        out = []
        for k in range(start[0], min(end[0] + 1, len(self.frames))):
            a, b = (start[1] if k == start[0] else 0), (end[1] if k == end[0] else None)
            if not a and b is None:
                out.append(self.frames[k])
            elif b is None or b > a:
                out.append(packed(unpacked(self.frames[k])[a:b]))
        return out


def infilled(
    stored: DataFrame, seed: str = "42", rate: int = 50, suffix_first: int = 80
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of stored texts; ``output`` has the frames.

    Cuts and form follow from the SHA-256 of ``seed``, a colon and the id alone. ``rate`` of a hundred texts are
    transformed, of a hundred of these ``suffix_first`` with the suffix first. Texts that are empty or hold
    a mark, and rows without an id, stay plain. Either part may be empty.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)

    def part(k: int) -> Column:
        return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")

    one, two = (part(k) % (F.col("n") + 1) for k in range(2))
    plain = (F.col("n") == 0) | F.col("marked") | (part(2) % 100 >= rate) | F.col("doc_id").isNull()
    form = F.when(plain, "plain").when(part(3) % 100 < suffix_first, "spm").otherwise("psm")
    asked = stored.select("doc_id", "n", "before", "chars", "frames", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))

    def run(batches):
        marks = {mark: packed(mark.encode()) for mark in (PREFIX, SUFFIX, MIDDLE)}
        for batch in batches:
            made: list[list] = [[] for _ in range(3)]
            for n, before, chars, frames, form, first, second in zip(*(batch.column(c).to_pylist() for c in range(1, 8)), strict=True):
                prefix = middle = None
                if form != "plain":
                    text = Stored(n, before, chars, frames)
                    a, b = text.seek(first), text.seek(second)
                    parts = {PREFIX: ((0, 0, 0), a), MIDDLE: (a, b), SUFFIX: (b, (len(frames), 0, 0))}
                    frames = [frame for mark in ORDERS[form] for frame in (marks[mark], *text.between(*parts[mark]))]
                    prefix, middle = a[2], b[2] - a[2]
                for column, value in zip(made, (prefix, middle, frames), strict=True):
                    column.append(value)
            columns = [batch.column(0), batch.column(1), batch.column(5), *(pa.array(m, k) for m, k in zip(made, (pa.int64(), pa.int64(), pa.list_(pa.binary())), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return asked.mapInArrow(lean(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>")


def parted(frames: list[bytes], marks: tuple[str, ...]) -> dict[str, list[bytes]]:
    """The frames of the part after each mark. Marks stand in the given order and the first begins the
    stream; a mark may lie across frames."""
    out: dict[str, list[bytes]] = {}
    ahead = [mark.encode() for mark in marks]
    own: list[bytes] = []
    held, k = b"", 0
    for frame in frames:
        raw, whole = held + unpacked(frame), not held
        while k < len(ahead) and (at := raw.find(ahead[k])) >= 0:
            if at:
                own.append(packed(raw[:at]))
            own, raw, whole = out.setdefault(marks[k], []), raw[at + len(ahead[k]) :], False
            k += 1
        # The end may be the beginning of the next mark.
        short = max((s for s in range(1, len(ahead[k])) if raw.endswith(ahead[k][:s])), default=0) if k < len(ahead) else 0
        held = raw[len(raw) - short :]
        if whole and not held:
            own.append(frame)
        elif len(raw) > short:
            own.append(packed(raw[: len(raw) - short]))
    if held:
        own.append(packed(held))
    return out


def restored(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text``: the frames of the text, rebuilt from ``output`` and ``form`` alone."""

    def run(batches):
        for batch in batches:
            texts = []
            for form, frames in zip(batch.column("form").to_pylist(), batch.column("output").to_pylist(), strict=True):
                if form in ORDERS:
                    own = parted(frames, ORDERS[form])
                    frames = [*own[PREFIX], *own[MIDDLE], *own[SUFFIX]]
                texts.append(frames)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.list_(pa.binary()))], [*batch.schema.names, "text"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lean(run), f"{kept}, text array<binary>")


def digested(rows: DataFrame, **columns: str) -> DataFrame:
    """``rows`` with a column of digests, lowercase hex of SHA-256, in place of each column of frames named:
    ``digested(rows, text="text_sha256")``."""

    def run(batches):
        for batch in batches:
            out = [batch.column(c) for c in batch.schema.names if c not in columns]
            for name in columns:
                made = []
                for frames in batch.column(name).to_pylist():
                    digest = hashlib.sha256()
                    for frame in frames:
                        digest.update(unpacked(frame))
                    made.append(digest.hexdigest())
                out.append(pa.array(made, pa.string()))
            names = [c for c in batch.schema.names if c not in columns] + list(columns.values())
            yield pa.RecordBatch.from_arrays(out, names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in columns)
    made = ", ".join(f"`{name}` string" for name in columns.values())
    return rows.mapInArrow(lean(run), f"{kept}, {made}")


def texts(rows: DataFrame, frames_col: str = "text") -> DataFrame:
    """``rows`` with the text of a column of frames, unpacked, in its place."""

    def run(batches):
        for batch in batches:
            whole = [b"".join(map(unpacked, frames)).decode() for frames in batch.column(frames_col).to_pylist()]
            columns = [pa.array(whole, pa.string()) if c == frames_col else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    kept = ", ".join(f"`{f.name}` " + ("string" if f.name == frames_col else f.dataType.simpleString()) for f in rows.schema.fields)
    return rows.mapInArrow(lean(run), kept)
