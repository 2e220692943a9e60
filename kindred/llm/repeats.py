"""Repeated passages by prefix-free parsing.

A text is parsed at triggers: in every string of ``length`` bytes the rolling hash of ``GRAM`` bytes is
least at one place (the leftmost, if several), and that place is its trigger. Strings that follow each
other and share a trigger form a phrase; equal strings have equal triggers, so they lie at the same
place of phrases with the same trigger gram, and every string is in exactly one phrase.

* The dictionary holds the distinct phrases, the parse the places where they occur. All but the first
  place of a phrase repeat whole.
* What is left are phrases that share a trigger gram but not all of their text: around edits, and at
  the ends of shared passages. Their suffixes, as far as ``length`` bytes, are sorted. The dictionary's
  suffix array is in the order of the text, and within equal text in that of the parse, so of
  neighbours that agree in ``length`` bytes the first is the first in the corpus, and the others
  repeat it.

A chunk of texts first finds the repeats among its own phrases, so a passage or copy that a third of
the texts hold reaches the shuffle once for each chunk.

A line that many texts hold, each with a text of its own after it, gives one trigger gram as many distinct
phrases. Such grams are counted first, and their phrases are cut into strings of ``length`` bytes, each
of which has its own hash for a key. So equal strings still meet, and no key holds more phrases
than a sort does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.bpe import powers
from kindred.llm.common import give_back, lean, mix, pieces, spans_of_text, staged
from kindred.session import parallelism

#: Bytes of the rolling hash, of texts parsed at once, and of phrases whose suffixes are sorted at once.
GRAM, CHUNK_BYTES, SORT_BYTES = 24, 1 << 20, 1 << 20
#: Distinct phrases of a key, about, beyond which it is split by string; they are counted in one of so many phrases.
SPLIT, SAMPLE = 2048, 16
#: Neighbours of a suffix array that are compared at once.
STEP = 1 << 16


def parsed(held: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, name, row, start, strings, offset) of the phrases of some texts: hashes of the trigger
    gram and of the phrase, the text's row, the byte of the first string in it, the number of
    strings, and from the first string to the trigger."""
    n, gram = len(held), min(GRAM, length)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, *[np.int64] * 4))
    value, up, down = powers(n + (1 << 18))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value[held] * up[:n], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # The place in the low bits: the least value of a range tells where it is, and the leftmost wins.
    mask = np.uint64((1 << max(20, n.bit_length())) - 1)
    least, reach, wanted = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64), 1, length - gram + 1
    while reach * 2 <= wanted:
        least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
    if wanted > reach:
        least = np.minimum(least[: reach - wanted], least[wanted - reach :])
    trigger = (least & mask).astype(np.int64)
    sizes = np.diff(begin)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(trigger)]
    start = np.flatnonzero(np.arange(len(trigger)) + length <= begin[1:][row])
    if not len(start):
        return parsed(held[:0], begin[:1], length)
    trigger, row = trigger[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    strings = np.diff(np.append(first, len(start)))
    start, trigger, row = start[first], trigger[first], row[first]
    offset = trigger - start
    shape = mix((strings.astype(np.uint64) << np.uint64(32)) + offset.astype(np.uint64) + np.uint64(1))
    name = mix((sums[start + strings - 1 + length] - sums[start]) * down[start] + shape)
    return grams[trigger], name, row, start - begin[row], strings, offset


PHRASES = "key long, name long, doc long, start long, strings long, offset long"
COLUMNS = ["key", "name", "doc", "start", "strings", "offset"]
#: ``offset`` of a row that is no phrase but a place found to repeat.
REPEAT = -1


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], COLUMNS)


def _places(key: np.ndarray, name: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, again): rows by (key, name, doc, start), and in that order the first place of each
    (key, name) and the other places, which are not rows that are there twice."""
    order = np.lexsort((start, doc, name, key))
    key, name, doc, start = (c[order] for c in (key, name, doc, start))
    lead = np.ones(len(key), bool)
    lead[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    head = np.maximum.accumulate(np.where(lead, np.arange(len(key)), 0))
    return order, lead, ~lead & ((doc != doc[head]) | (start != start[head]))


def _repeats(doc: np.ndarray, start: np.ndarray, strings: np.ndarray) -> pa.RecordBatch:
    where = mix(doc.astype(np.uint64) + start.astype(np.uint64) * np.uint64(2654435761))
    return _rows(where, where, doc, start, strings, np.full(len(doc), REPEAT))


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes of a chunk of texts, key, name, doc, start, strings, offset, byte of the chunk) of the phrases."""
    for batch in batches:
        known = np.asarray(batch.column(0).is_valid())
        ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
        data, offsets = spans_of_text(batch.column(1))
        for first, last in pieces(offsets, CHUNK_BYTES):
            held, begin = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            found = parsed(held, begin, length)
            keep = known[first + found[2]]
            key, name, row, start, strings, offset = (f[keep] for f in found)
            yield held, key, name, ids[first + row], start, strings, offset, begin[row] + start


def _sampled(length: int) -> Callable:
    """(key, name) of one in ``SAMPLE`` distinct phrases, picked by the hash of the phrase."""

    def run(batches):
        for _, key, name, *_ in _chunks(batches, length):
            keep = mix(name) % np.uint64(SAMPLE) == 0
            pairs = np.unique(np.stack([key[keep], name[keep]], 1).view(np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "name"])

    return run


def _parse(length: int, large: np.ndarray) -> Callable:
    """The phrases of texts. A phrase whose key is in ``large`` is cut into its strings, each a phrase under a
    key of its own, the hash of its bytes."""

    def run(batches):
        for held, *found in _chunks(batches, length):
            order, lead, again = _places(*found[:4])
            key, name, doc, start, strings, offset, at = (c[order] for c in found)
            yield _repeats(doc[again], start[again], strings[again])
            cut = lead & np.isin(key, large)
            whole = lead & ~cut
            yield _rows(*(c[whole] for c in (key, name, doc, start, strings, offset)))
            if not cut.any():
                continue
            many = strings[cut]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            trigger, doc, start, offset, at = (np.repeat(c[cut], many) for c in (key, doc, start, offset, at))
            start, offset, at = start + step, offset - step, at + step
            value, up, down = powers(len(held) + (1 << 18))
            sums = np.zeros(len(held) + 1, np.uint64)
            np.cumsum(value[held] * up[: len(held)], out=sums[1:])
            code = mix((sums[at + length] - sums[at]) * down[at] + mix(offset.astype(np.uint64) + np.uint64(1)))
            order, lead, again = _places(code, trigger, doc, start)
            code, trigger, doc, start, offset = (c[order] for c in (code, trigger, doc, start, offset))
            yield _rows(*(c[lead] for c in (code, trigger, doc, start, np.ones(len(code), np.int64), offset)))
            # Repeated strings that follow each other are one place.
            doc, start = doc[again], start[again]
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc))[: len(first)] - 1
            yield _repeats(doc[first], start[first], start[last] - start[first] + 1)

    return run


def _large(picked: DataFrame, length: int) -> np.ndarray:
    """Keys with more than about ``SPLIT`` distinct phrases. Which keys near that number are among them does not
    change what repeats. There is at most one for every ``SPLIT`` or so phrases of the corpus."""
    found = picked.mapInArrow(lean(_sampled(length)), "key long, name long").distinct().groupBy("key").count()
    rows = found.where(F.col("count") * SAMPLE > SPLIT).select("key").collect()
    return np.array(sorted(r["key"] for r in rows), np.int64).view(np.uint64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of phrases sorted by (key, name, doc, start): the later places of a phrase repeat; the first
    place goes on if its key has another phrase. Holds one row between batches."""
    state = None  # last row seen, first place of its phrase, and that row if it waits for its key's next
    for batch in batches:
        columns = np.stack([c.to_numpy() for c in batch.columns], 1)
        done = columns[columns[:, 5] == REPEAT]
        columns = columns[columns[:, 5] != REPEAT]
        if len(done):
            yield _rows(*done.T)
        if not len(columns):
            continue
        key, name = columns[:, 0], columns[:, 1]
        before_key, before_name = np.roll(key, 1), np.roll(name, 1)
        same_key, same = key == before_key, (key == before_key) & (name == before_name)
        if state is None:
            same_key[0] = same[0] = False
        else:
            same_key[0] = key[0] == state["key"]
            same[0] = same_key[0] and name[0] == state["name"]
        lead = np.flatnonzero(~same)
        if state is not None and state["wait"] is not None and len(lead):
            # The waiting phrase: mixed if the next phrase has its key.
            if key[lead[0]] == state["wait"][0]:
                yield _rows(*np.array([state["wait"]]).T)
            state["wait"] = None
        head = np.maximum.accumulate(np.where(~same, np.arange(len(key)), -1))
        own = head >= 0
        at = np.where(own[:, None], columns[np.maximum(head, 0)][:, 2:4], state["first"] if state is not None else 0)
        again = same & ((columns[:, 2:4] != at).any(1))
        repeats = columns[again].copy()
        repeats[:, 5] = REPEAT
        if len(repeats):
            yield _rows(*repeats.T)
        mixed = same_key[lead].copy()  # another phrase of the key came before
        mixed[:-1] |= key[lead[1:]] == key[lead[:-1]]
        wait = None if state is None else state["wait"]
        if len(lead):
            ready = columns[lead][mixed]
            if len(ready):
                yield _rows(*ready.T)
            wait = None if mixed[-1] else columns[lead[-1]].tolist()
        state = {"key": key[-1], "name": name[-1], "first": at[-1], "wait": wait}


def _texts(length: int) -> Callable:
    """Text of the phrases of each row (id, text, phrases)."""

    def run(batches):
        for batch in batches:
            data, offsets = spans_of_text(batch.column(1))
            raw = data.tobytes()
            for r, phrases in enumerate(batch.column(2).to_pylist()):
                base, doc = int(offsets[r]), batch.column(0)[r].as_py()
                found = [
                    (p["key"], doc, p["start"], p["offset"], raw[base + p["start"] : base + p["start"] + p["strings"] - 1 + length])
                    for p in phrases
                ]
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.binary()), strict=True)],
                    ["key", "doc", "start", "offset", "text"],
                )

    return run


def _sort(length: int) -> Callable:
    """Of phrases (key, doc, start, offset, text) sorted by key and place, the strings that an earlier
    phrase has: the suffixes of whole groups of a key are sorted together. Of a group that fills more than
    one sort, digests of the distinct strings go on to the next."""

    def sort(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, string of the phrase, whether it repeats an earlier one)"""
        flat = np.frombuffer(b"".join(texts), np.uint8)
        many = np.array([len(t) - length + 1 for t in texts], np.int64)
        base = np.cumsum(many + length - 1) - (many + length - 1)
        phrase = np.repeat(np.arange(len(texts)), many)
        string = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = base[phrase] + string
        view = np.lib.stride_tricks.as_strided(flat, (len(flat) - length + 1, length), (1, 1))
        suffixes = np.ascontiguousarray(view[at]).view(f"V{length}").ravel()
        array = np.argsort(suffixes, kind="stable")  # equal ones in the order of the corpus
        again = np.zeros(len(at), bool)
        for lo in range(1, len(array), STEP):
            hi = lo + STEP
            again[array[lo:hi]] = suffixes[array[lo:hi]] == suffixes[array[lo - 1 : hi - 1][: len(array[lo:hi])]]
        return phrase, string, again

    def run(batches):
        key, docs, starts, texts, size = None, [], [], [], 0
        edges = [0]  # where groups begin
        earlier: set[bytes] = set()  # digests of the strings of the open group's earlier parts

        def flush(n: int, open_group: bool):
            nonlocal earlier
            phrase, string, again = sort(texts[:n])
            if earlier or open_group:
                digest = lambda p, s: hashlib.blake2b(texts[p][s : s + length], digest_size=16).digest()
                cutoff = edges[-1] if open_group else n
                for i in range(len(phrase)):
                    p = int(phrase[i])
                    if (earlier and p < (edges[1] if len(edges) > 1 else n)) or (open_group and p >= cutoff):
                        d = digest(p, int(string[i]))
                        if not again[i] and d in earlier:
                            again[i] = True
                if open_group:
                    fresh = {digest(int(phrase[i]), int(string[i])) for i in np.flatnonzero(~again & (phrase >= cutoff))}
                    earlier = (earlier if cutoff == 0 else set()) | fresh
                else:
                    earlier = set()
            # Runs of repeated strings become spans.
            hit = np.flatnonzero(again)
            if not len(hit):
                return None
            p, s = phrase[hit], string[hit]
            new = np.ones(len(hit), bool)
            new[1:] = (p[1:] != p[:-1]) | (s[1:] > s[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(hit)) - 1
            doc, start = np.array(docs[:n]), np.array(starts[:n])
            return pa.RecordBatch.from_arrays(
                [pa.array(doc[p[first]]), pa.array(start[p[first]] + s[first]), pa.array(start[p[last]] + s[last] + length)], ["doc", "first", "last"]
            )

        for batch in batches:
            for k, doc, start, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True):
                if docs and k == key and doc == docs[-1] and start == starts[-1]:
                    continue  # the row is there twice
                if size >= SORT_BYTES:
                    out = flush(len(texts), k == key)
                    if out is not None:
                        yield out
                    docs, starts, texts, size, edges = [], [], [], 0, [0]
                elif k != key and docs:
                    edges.append(len(docs))
                key = k
                docs.append(doc)
                starts.append(start)
                texts.append(text)
                size += len(text)
        if texts and (out := flush(len(texts), False)) is not None:
            yield out

    return run


def _hash(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _several(picked: DataFrame) -> DataFrame | None:
    """(doc, least) of the ids that have more than one text: the least hash of a text. None if there are none."""
    hashes = picked.where("doc IS NOT NULL").groupBy("doc").agg(F.min(_hash("text")).alias("least"), F.max(_hash("text")).alias("most"))
    odd = staged(hashes.where("least <> most").select("doc", "least"), "odd")
    return None if odd.isEmpty() else odd


def _stands(text: str, least: F.Column) -> F.Column:
    """Whether the text is that its id stands for; ``least`` is null for ids with one text."""
    return least.isNull() | (_hash(text) == least)


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first, last): byte spans, which may touch and overlap, that together are all bytes covered by a
    string of ``length`` bytes that also starts earlier (in a smaller id, or earlier in the same text).

    Null text is empty. Texts without an id neither repeat nor are repeated. Rows that repeat an id
    and its text are one text, and no repeat of themselves; of an id with several texts only the one of
    least hash counts, the others neither repeat nor are repeated.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    return _spans(picked, _several(picked), length)


def _spans(picked: DataFrame, odd: DataFrame | None, length: int) -> DataFrame:
    if odd is not None:
        picked = picked.join(odd, "doc", "left").where(_stands("text", F.col("least"))).drop("least")
    n = parallelism(picked.sparkSession)
    phrases = picked.mapInArrow(lean(_parse(length, _large(picked, length))), PHRASES)
    dealt = phrases.repartition(n, "key").sortWithinPartitions("key", "name", "doc", "start")
    parse = staged(dealt.mapInArrow(lean(_compare), PHRASES), "parse")
    mixed = parse.where(F.col("offset") != REPEAT).groupBy("doc").agg(F.collect_list(F.struct("key", "start", "strings", "offset")).alias("phrases"))
    texts = picked.join(mixed, "doc").select("doc", "text", "phrases")
    texts = texts.mapInArrow(lean(_texts(length)), "key long, doc long, start long, offset long, text binary")
    dictionary = texts.repartition(n, "key").sortWithinPartitions("key", "doc", "start")
    parts = staged(dictionary.mapInArrow(lean(_sort(length)), "doc long, first long, last long"), "spans")
    whole = parse.where(F.col("offset") == REPEAT)
    whole = whole.select("doc", F.col("start").alias("first"), (F.col("start") + F.col("strings") - 1 + length).alias("last"))
    return parts.unionAll(whole).withColumnRenamed("doc", "id")


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that any span covers."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"]) for s in (() if spans is None else spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, length: int, id_col: str, text_col: str, name: str) -> DataFrame:
    picked = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    odd = _several(picked)
    by_doc = _spans(picked, odd, length).groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    if odd is None:
        return docs.join(by_doc.select(F.col("id").alias(id_col), F.col("spans").alias(name)), id_col, "left")
    both = by_doc.join(odd.withColumnRenamed("doc", "id"), "id", "left")
    held = docs.join(both.select(F.col("id").alias(id_col), F.struct("spans", "least").alias(name)), id_col, "left")
    return held.withColumn(name, F.when(_stands(text_col, F.col(f"{name}.least")), F.col(f"{name}.spans")))


def removed(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): what `repeated_spans` takes from each row."""

    def run(batches):
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            data, offsets = spans_of_text(batch.column(1))
            raw = memoryview(data.tobytes())
            sizes, gone, digests, runs = [], [], [], []
            for r, spans in enumerate(batch.column(2).to_pylist()):
                text, cuts, sha, at = raw[offsets[r] : offsets[r + 1]], merged(spans), hashlib.sha256(), 0
                for a, b in cuts:
                    sha.update(text[at:a])
                    at = b
                sha.update(text[at:])
                sizes.append(len(text))
                gone.append(sum(b - a for a, b in cuts))
                digests.append(sha.hexdigest())
                runs.append([{"first": a, "last": b} for a, b in cuts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(c) for c in runs], pa.int64()), pa.array(digests, pa.string()), pa.array(runs, kind)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    picked = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    found = _with_spans(picked, length, "doc", "text", "spans").select("doc", "text", "spans")
    return found.mapInArrow(
        lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>"
    )


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the repeats cut from the text; a character goes only with all its bytes.
    Null text stays null."""

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        give_back()
        out = []
        for text, own in zip((t.as_py() for t in texts), (s.as_py() for s in spans), strict=True):
            if text and own is not None and len(own):
                raw, kept, at = text.encode(), [], 0
                for a, b in merged(own):
                    while a < b and raw[a] & 0xC0 == 0x80:  # not the rest of a character that stays
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(raw[at:a])
                    at = max(at, b)
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        return pa.array(out, pa.string())

    name = "spans"
    while name in docs.columns:
        name = "_" + name
    rows = _with_spans(docs, length, id_col, text_col, name)
    fixed = F.arrow_udf(cut, "string")(F.col(text_col), F.col(name))
    return rows.withColumn(text_col, fixed).select(*docs.columns)
