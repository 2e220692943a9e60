"""Best-fit packing of token sequences by patterns.

Documents become pieces of at most ``limit`` tokens; all that the plan needs of them is how many
there are of each length, at most ``limit`` numbers however large the table. Patterns of a few
lengths that fill a sequence to the last token are enumerated, repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what remains is packed best-fit
decreasing, again by length and count, never by document. The plan is then dealt back: the pieces
of a length are numbered, and each range of numbers has its pattern, its sequences and its place.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.bpe import Pieces, chunks
from kindred.llm.common import lean, staged
from kindred.session import parallelism

#: Id after the last token of a document.
END = 0
#: Steps of the fit, and patterns of three lengths that are tried for each longest length.
STEPS, THIRDS = 400, 24
#: Parts that the pieces of one length are numbered in.
SALTS = 64


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    """Ids by pre-token, from the vocabulary of a ``tokenizers`` file. One pre-token cannot hold another,
    so its ids do not depend on the text around it."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    model, own = Tokenizer.from_file(path).model, special_of(path)
    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def ids(piece: bytes) -> tuple[int, ...]:
        if piece in own:
            return (own[piece],)
        return tuple(t.id for t in model.tokenize(spell(piece.decode())[0][0]))

    return Pieces(ids)


@lru_cache(2)
def special_of(path: str) -> dict[bytes, int]:
    """The added tokens of a ``tokenizers`` file, which its library finds in a text before anything else."""
    from tokenizers import Tokenizer

    return {token.content.encode(): number for number, token in Tokenizer.from_file(path).get_added_tokens_decoder().items()}


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the limit."""
    first = n % limit or limit
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def tokenised(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row's text, ended by id 0.

    Null text is empty, one piece of one token. Rows that repeat are documents of their own. The string
    of a special token in a text is that token, as the library has it by default."""

    def run(batches):
        cache, special = pieces_of(path), tuple(special_of(path))
        for batch in batches:
            made: list[list] = [[] for _ in range(6)]
            row = 0
            for c in chunks(batch.column(1), special):
                flat, edges = c.ids(cache)
                flat = flat.astype("<u4")
                for lo, hi in zip(c.rows[:-1], c.rows[1:], strict=True):
                    ids = np.append(flat[edges[lo] : edges[hi]], np.array([END], "<u4"))
                    for k, (start, length) in enumerate(cut(len(ids), limit)):
                        own = ids[start : start + length]
                        for column, value in zip(made, (row, k, start, length, zlib.crc32(own.tobytes()), own), strict=True):
                            column.append(value)
                    row += 1
            columns = [batch.column(0).take(pa.array(made[0], pa.int64())), pa.array(made[1], pa.int32()), *(pa.array(m, pa.int64()) for m in made[2:5])]
            if with_ids:
                columns.append(pa.array(made[5], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), schema)


def patterns(have: np.ndarray, limit: int) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill the limit exactly, from lengths that occur."""
    found = []
    lengths = np.flatnonzero(have)
    if limit < len(have) and have[limit]:
        found.append([(limit, 0, 0, 0)])
    two = lengths[(lengths * 2 >= limit) & (lengths < limit)]
    two = two[have[limit - two] > 0]
    found.append(np.stack([two, limit - two, 0 * two, 0 * two], 1))
    common = lengths[np.argsort(-have[lengths], kind="stable")]
    for fixed in (0, *common[: THIRDS // 4]):  # a fourth length is one of the commonest
        for c in common[:THIRDS]:
            rest = limit - c - fixed
            a = lengths[(lengths * 2 >= rest) & (lengths < rest)]
            a = a[have[rest - a] > 0]
            found.append(np.stack([a, rest - a, 0 * a + c, 0 * a + fixed], 1))
    rows = np.sort(np.concatenate([np.asarray(f, np.int64).reshape(-1, 4) for f in found]), axis=1)[:, ::-1]
    return np.unique(rows, axis=0)


def fit(rows: np.ndarray, have: np.ndarray) -> np.ndarray:
    """How often to repeat each pattern: non-negative least squares by scaled projected steps.

    A step goes down the gradient, each pattern scaled by how many others share its lengths, and
    is cut at zero."""
    used = rows > 0
    want = have.astype(float)
    share = np.zeros(len(have))
    np.add.at(share, rows[used], 1.0)
    scale = 1.0 / np.where(used, share[rows], 0.0).sum(1)
    x = np.zeros(len(rows))
    ahead, t = x.copy(), 1.0
    for _ in range(STEPS):
        made = np.zeros(len(have))
        np.add.at(made, rows[used], np.broadcast_to(ahead[:, None], rows.shape)[used])
        gap = want - made
        nxt = np.maximum(0.0, ahead + scale * np.where(used, gap[rows], 0.0).sum(1))
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x


def best_fit(left: dict[int, int], limit: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing by length and count: [(lengths with their numbers, sequences)]."""
    open_: dict[int, list[list]] = defaultdict(list)  # free space: [pattern, sequences]
    spaces: list[int] = []
    full = []
    for length in sorted((n for n in left if left[n]), reverse=True):
        count = left[length]
        while count:
            k = bisect.bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                pattern, many = open_[space].pop()
                if not open_[space]:
                    spaces.pop(k)
            else:
                space, pattern, many = limit, (), -(-count // (limit // length))
            each = space // length
            take = min(many, count // each)
            if take == 0:
                each, take = count, 1
            if many > take:
                if not open_[space] and space != limit:
                    bisect.insort(spaces, space)
                if space != limit:
                    open_[space].append([pattern, many - take])
            count -= each * take
            free, own = space - each * length, (*pattern, (length, each))
            if free:
                if not open_[free]:
                    bisect.insort(spaces, free)
                open_[free].append([own, take])
            else:
                full.append((own, take))
    return full + [(p, n) for entries in open_.values() for p, n in entries if n]


def plan(histogram: dict[int, int], limit: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(lengths with their numbers, how many sequences)] for pieces given as {length: number}."""
    have = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        have[length] += n
    out, left = [], have.copy()
    rows = patterns(have, limit)
    if len(rows):
        wish = fit(rows, have)
        # Rounded down, commonest first, and never beyond the pieces that are left.
        for j in np.argsort(-wish, kind="stable"):
            parts = Counter(int(v) for v in rows[j] if v)
            times = min(int(wish[j]), *(int(left[v]) // m for v, m in parts.items()))
            if times > 0:
                for v, m in parts.items():
                    left[v] -= times * m
                out.append((tuple(sorted(parts.items(), reverse=True)), times))
    return out + best_fit({int(v): int(left[v]) for v in np.flatnonzero(left)}, limit)


def allotted(made: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length and number: from which number on which sequences and places hold."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for parts, times in made:
        at = 0
        for length, many in parts:
            rows.append((length, taken[length], times, sequence, at))
            taken[length] += times * many
            at += length * many
        sequence += times
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("length", "first", "times", "sequence", "at"))}


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``number``, 0 and up within their length. A length that a third of all pieces have is
    numbered in parts, each after the ones before it."""
    salts = max(SALTS, 2 * parallelism(rows.sparkSession))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("many"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(counts, ["length", "salt"]).withColumn("number", F.col("before") + F.col("rank")).drop("salt", "rank", "before")


def pack(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): one row per piece.

    No documents give no rows. Ties among pieces of one length are dealt by id."""
    rows = staged(tokenised(docs, path, limit, id_col, text_col, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `limit` rows
    deal = allotted(plan(histogram, limit))
    widest = max(histogram.values(), default=0) + 1
    names = [*rows.columns[:5], "sequence_id", "offset", *rows.columns[5:]]

    def run(batches):
        key = deal["length"] * widest + deal["first"]
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            k = np.searchsorted(key, length * widest + number, side="right") - 1
            inner = number - deal["first"][k]
            extra = {
                "sequence_id": deal["sequence"][k] + inner % np.maximum(deal["times"][k], 1),
                "offset": deal["at"][k] + inner // np.maximum(deal["times"][k], 1) * length,
            }
            columns = [pa.array(extra[c]) if c in extra else batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return numbered(rows).mapInArrow(lean(run), schema)
