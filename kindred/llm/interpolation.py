"""Language-model scores by deleted interpolation of n-grams (words and pairs of words).

The probability of a word after a context mixes three estimates: the pair's share of the context's
count, the word's share of all tokens, and the add-half estimate that no word escapes. The weights
depend on how often the context occurs, by powers of two, and are learnt by expectation-maximisation:
every fourth text of a block is scored with the counts of these texts deleted from the totals, then the
next ones, so that every training token is held out once.

Counts move in blocks. A block is some texts of one partition; it sends its distinct n-grams once,
sorted, cut into ranges of the key, and gets the totals back in the same order, without the keys. Tasks
hold a block, or one range of all blocks; with blocks near the root of 500 times the number of tokens,
both grow as that root and the rows shuffled in proportion to the input. No count is sampled, cut or
sent to the driver; it gets sums over bounded bins, for the weights.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import fold, lean, mix, release, spans_of_text, staged
from kindred.llm.shingles import STEP, words
from kindred.session import parallelism

#: The token after the last word, which is also the context of the first.
END = np.uint64(0x0123456789ABCDEF)
#: Least tokens of a block, n-grams of a range that pay for a row, bins of a doubling, rounds of EM,
#: and parts of a block that are deleted in turn.
LEAST_BLOCK, PER_RANGE, BINS, ROUNDS, DELETED = 1_250_000, 500, 8, 60, 4
HELD_PARTS, HELD = 5, 1


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of their order of magnitude, so that small ones take little room."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes: the upper bytes hardly change from one to the next."""
    planes = np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T)
    upper = zlib.compress(planes[:3].tobytes(), 1)
    return len(upper).to_bytes(4, "little") + upper + planes[3:].tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    upper = np.frombuffer(zlib.decompress(data[4 : 4 + n]), np.uint8)
    planes = np.concatenate([upper, np.frombuffer(data[4 + n :], np.uint8)]).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64)


def _blocks(docs: DataFrame, most: int) -> DataFrame:
    """(block, ids, held, ends, tokens, words): texts as places in the block's word hashes."""

    def run(batches):
        parts, size, number = [], 0, TaskContext.get().partitionId() << 32

        def flush():
            nonlocal number
            ids, held, ends, code = (np.concatenate([p[i] for p in parts]) for i in range(4))
            words_, tokens, many = np.unique(code, return_inverse=True, return_counts=True)
            common = np.argsort(-many, kind="stable")  # the commonest word is 0
            words_, place = words_[common], np.empty(len(common), np.int64)
            place[common] = np.arange(len(common))
            tokens = place[tokens]
            valid = np.concatenate([p[4] for p in parts])
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([pa.array(ids, mask=~valid).to_pylist()], pa.list_(pa.int64())),
                    pa.array([held.tolist()], pa.list_(pa.bool_())),
                    pa.array([np.cumsum(ends).tolist()], pa.list_(pa.int64())),
                    pa.array([_pack(tokens)], pa.binary()),
                    pa.array([words_.tobytes()], pa.binary()),
                ],
                ["block", "ids", "held", "ends", "tokens", "words"],
            )

        for batch in batches:
            valid = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
            held = batch.column(2).to_numpy(zero_copy_only=False)
            data, offsets = spans_of_text(batch.column(1))
            for first, last, code, begin in words(data, offsets):
                counts = np.diff(begin) + 1
                code = np.insert(code, begin[1:], END)
                parts.append((ids[first:last], held[first:last], counts, code, valid[first:last]))
                size += len(code)
                if size >= most:
                    yield flush()
                    parts, size = [], 0
        if parts:
            yield flush()

    schema = "block long, ids array<long>, held array<boolean>, ends array<long>, tokens binary, words binary"
    return docs.mapInArrow(lean(run), schema)


class Block:
    """A block's tokens, its n-grams and where they stand."""

    def __init__(self, ids, held, ends, tokens: bytes, words_: bytes):
        self.ids, self.held, self.ends = ids, np.array(held, bool), np.array(ends, np.int64)
        self.tokens = _unpack(tokens)
        named = np.frombuffer(words_, np.uint64)
        end = int(np.flatnonzero(named == END)[0])
        sizes = np.diff(self.ends, prepend=0)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.before = np.empty_like(self.tokens)  # the context of each token
        self.before[1:] = self.tokens[:-1]
        self.before[np.append(0, self.ends[:-1])] = end
        one = np.uint64(1)
        singles = mix(named) | one
        pairs = mix(named[self.before] * STEP + named[self.tokens]) & ~one
        unique, self.pair = np.unique(pairs, return_inverse=True)
        order = np.argsort(np.concatenate([singles, unique]), kind="stable")
        self.keys = np.concatenate([singles, unique])[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word_at, self.pair_at = place[: len(singles)], place[len(singles) :]
        trained = ~self.held[self.row]
        self.own = np.zeros(len(order), np.int64)  # counts in the block's training texts
        self.own[self.word_at] = np.bincount(self.tokens[trained], minlength=len(singles))
        self.own[self.pair_at] = np.bincount(self.pair[trained], minlength=len(unique))
        # As a context a word counts as often as it is followed by a token: as often as it occurs.


def _asked(blocks: DataFrame, bits: int) -> DataFrame:
    """(part, block, keys, own): the n-grams of each block by range."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                b = Block(*(batch.column(c)[r].as_py() for c in range(1, 6)))
                part = (b.keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(b.keys), np.int64)
                edges = np.searchsorted(part, np.arange((1 << bits) + 1))
                found = [p for p in range(1 << bits) if edges[p + 1] > edges[p]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found, pa.int64()),
                        pa.array([batch.column(0)[r].as_py()] * len(found), pa.int64()),
                        pa.array([_pack_keys(b.keys[edges[p] : edges[p + 1]]) for p in found], pa.binary()),
                        pa.array([_pack(b.own[edges[p] : edges[p + 1]]) for p in found], pa.binary()),
                    ],
                    ["part", "block", "keys", "own"],
                )

    return blocks.mapInArrow(lean(run), "part long, block long, keys binary, own binary")


def _totals(asked: DataFrame) -> DataFrame:
    """(block, part, totals, kinds, tokens): total training counts in the order of the block's keys;
    rows without a block have the number of distinct training words and of training tokens."""

    def run(batches):
        part, rows = None, []

        def flush():
            keys = [_unpack_keys(k) for _, k, _ in rows]
            own = [_unpack(o) for _, _, o in rows]
            unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.zeros(len(unique), np.int64)
            np.add.at(totals, inverse, np.concatenate(own))
            single = (unique & np.uint64(1)) == 1
            edges = np.cumsum([0, *map(len, keys)])
            made = [_pack(totals[inverse[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*(b for b, _, _ in rows), None], pa.int64()),
                    pa.array([part] * (len(rows) + 1), pa.int64()),
                    pa.array([*made, None], pa.binary()),
                    pa.array([*[0] * len(rows), int((single & (totals > 0)).sum())], pa.int64()),
                    pa.array([*[0] * len(rows), int(totals[single].sum())], pa.int64()),
                ],
                ["block", "part", "totals", "kinds", "tokens"],
            )

        for batch in batches:
            for p, block, keys, own in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if p != part and rows:
                    yield flush()
                    rows = []
                part = p
                rows.append((block, keys, own))
        if rows:
            yield flush()

    n = parallelism(asked.sparkSession)
    ordered = asked.repartition(n, "part").sortWithinPartitions("part", "block")
    return ordered.mapInArrow(lean(run), "block long, part long, totals binary, kinds long, tokens long")


def _joined(blocks: DataFrame, totals: DataFrame, with_block, schema: str) -> DataFrame:
    """``with_block(block, totals in the order of its keys)`` for every block; gives batches."""
    none = lambda kind: F.lit(None).cast(kind)
    a = blocks.select("block", F.lit(-1).cast("long").alias("part"), "ids", "held", "ends", "tokens", "words", none("binary").alias("totals"))
    b = totals.where("block IS NOT NULL").select(
        "block", "part", none("array<long>").alias("ids"), none("array<boolean>").alias("held"), none("array<long>").alias("ends"),
        none("binary").alias("tokens"), none("binary").alias("words"), "totals",
    )

    def run(batches):
        head, parts = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column(1)[r].as_py() < 0:
                    if head is not None:
                        yield with_block(Block(*head), np.concatenate(parts))
                    head, parts = [batch.column(c)[r].as_py() for c in range(2, 7)], []
                else:
                    parts.append(_unpack(batch.column(7)[r].as_py()))
        if head is not None:
            yield with_block(Block(*head), np.concatenate(parts))

    n = parallelism(blocks.sparkSession)
    return a.unionAll(b).repartition(n, "block").sortWithinPartitions("block", "part").mapInArrow(lean(run), schema)


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for none, then one more with every doubling."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def _estimates(b: Block, counts: np.ndarray, tokens: int, kinds: int) -> tuple[np.ndarray, ...]:
    """(context count, pair share, word share, add-half estimate) of every token."""
    word, context, pair = counts[b.word_at][b.tokens], counts[b.word_at][b.before], counts[b.pair_at][b.pair]
    share = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    return context, share, word / max(tokens, 1), (word + 0.5) / (tokens + 0.5 * (kinds + 1))


def _weights(bins: list[tuple[int, int, int, int]], tokens: int, kinds: int) -> np.ndarray:
    """Mixture weights by bucket, from counts of (context bucket, bin of the pair's share over the
    word's add-half estimate, bucket of the word's count)."""
    most = max((b[0] for b in bins), default=0) + 1
    weights = np.full((max(most, 64), 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)
    for c in range(most):
        own = np.array([b[1:] for b in bins if b[0] == c], float).reshape(-1, 3)
        if not len(own):
            continue
        two = np.where(own[:, 0] > -9999, 2.0 ** (own[:, 0] / BINS), 0.0)
        many = np.where(own[:, 1] > 0, 2.0 ** (own[:, 1] - 0.5), 0.0)
        one = many / max(tokens, 1) * (tokens + 0.5 * (kinds + 1)) / (many + 0.5)
        likely = np.stack([two, one, np.ones(len(own))], 1)
        w = weights[c].copy()
        for _ in range(ROUNDS):
            shares = likely * w
            shares /= shares.sum(1, keepdims=True)
            w = (shares * own[:, 2:]).sum(0) + 1e-3 * (weights[c] > 0)
            w /= w.sum()
        weights[c] = w
    return weights


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = HELD_PARTS, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Texts whose id's crc32 modulo ``parts`` is ``held`` are scored but not learnt from; rows without
    an id are learnt from. Null text is empty, one end token. Rows that repeat count each time. With nothing
    to learn from, both scores are those of the add-half estimate.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    texts = texts.withColumn("held", F.coalesce(fold("doc_id", parts) == held, F.lit(False)))
    size = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    most = max(LEAST_BLOCK, int((PER_RANGE * size) ** 0.5))
    blocks = staged(_blocks(texts.select("doc_id", "text", "held"), most), "blocks")
    bits = max(0, min(size, most) // (4 * PER_RANGE)).bit_length()
    totals = staged(_totals(_asked(blocks, bits)), "totals")
    release(docs.sparkSession)
    sums = totals.where("block IS NULL").agg(F.sum("kinds"), F.sum("tokens")).first()
    kinds, tokens = sums[0] or 0, sums[1] or 0

    def bins(b: Block, counts: np.ndarray) -> pa.RecordBatch:
        codes = []
        for part in range(DELETED):
            out = ~b.held[b.row] & (b.row % DELETED == part)
            own = np.zeros_like(counts)
            own[b.word_at] = np.bincount(b.tokens[out], minlength=len(b.word_at))
            own[b.pair_at] = np.bincount(b.pair[out], minlength=len(b.pair_at))
            context, two, _, base = _estimates(b, counts - own, tokens - int(out.sum()), kinds)
            known = (counts - own)[b.word_at][b.tokens]
            ratio = np.full(len(two), -9999, np.int64)
            some = two > 0
            ratio[some] = np.round(BINS * np.log2(two[some] / base[some])).astype(np.int64)
            codes.append((bucket(context)[out] * 64 + bucket(known)[out]) * 32768 + ratio[out] + 16384)
        value, many = np.unique(np.concatenate(codes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(many, pa.int64())], ["bin", "many"])

    seen = _joined(blocks, totals, bins, "bin long, many long").groupBy("bin").agg(F.sum("many").alias("many")).collect()
    release(docs.sparkSession)
    weights = _weights([(r[0] >> 21, (r[0] & 32767) - 16384, (r[0] >> 15) & 63, r[1]) for r in seen], tokens, kinds)

    def score(b: Block, counts: np.ndarray) -> pa.RecordBatch:
        context, two, one, base = _estimates(b, counts, tokens, kinds)
        w = weights[bucket(context)]
        mixed = w[:, 0] * two + w[:, 1] * one + w[:, 2] * base
        n = len(b.ends)
        known = counts[b.word_at][b.tokens] > 0
        by_doc = lambda x: pa.array(np.bincount(b.row, weights=x, minlength=n))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(np.diff(b.ends, prepend=0)),
                pa.array(np.bincount(b.row, weights=known, minlength=n).astype(np.int64)), pa.array(np.full(n, tokens, np.int64)),
                by_doc(np.log10(base)), by_doc(np.log10(mixed if tokens else base)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return _joined(blocks, totals, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
