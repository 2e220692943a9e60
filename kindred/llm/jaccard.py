"""N-gram Jaccard join by T-occurrence search.

Two texts link when their sets of word shingles have a Jaccard similarity of at least
``percent`` / 100. Steps:

1. A text's set is cut into parts by a hash of the shingle. Linked sets differ in at most
   ``(100 - percent) * smaller / percent`` shingles; the other parts are the same in both, whatever the
   sets. So a set that links has at least as many signatures of parts in common with other sets
   as it has parts beyond that number; sets with fewer go no further. Exact copies are one set.
2. Sets that share a signature form groups. A group goes to one task, a large one in tiles of two
   bounded parts, so that every pair meets and no task holds more than two parts. The sets of a large
   group are written once, a folder for each part, and its tiles read two folders: no text is
   shuffled to each tile.
3. In a task the shingles of the group have inverted lists. For each text, shortest first, the
   short lists are merged, documents that reach the threshold less the number of long lists are
   probed in those by binary search (DivideSkip), and those that reach the required overlap link.
   A shingle that most texts of the group have is listed by the texts that lack it, which count
   down from one: among near copies nearly all lists are then short.

Every pair of different sets is looked at once and every link is counted, for all copies of either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred import stored
from kindred.llm.common import components, lean, mix, release, staged
from kindred.llm.shingles import shingles
from kindred.session import parallelism

#: Shingles in one part of a group; a task holds two parts at most.
PART = 1 << 20
#: Weight of a binary probe against a merged entry, for the number of long lists.
MU = 0.05
#: Sets whose copies a task leaves out, at most.
KNOWN = 500_000
#: Probes that are made at once.
PROBES = 1 << 20
SECOND = np.uint64(0xA0761D6478BD642F)


class Bands:
    """Ranges of set sizes, and how many parts the sets of a range are cut into."""

    def __init__(self, percent: int):
        self.percent = percent
        tops, ratio = [1], max(1.5, 100 / percent)
        while tops[-1] < 1 << 40:
            tops.append(max(tops[-1] + 1, int(tops[-1] * ratio)))
        self.tops = np.array(tops, np.int64)
        self.apart = (100 - percent) * self.tops // percent  # shingles that linked sets may differ in
        self.parts = self.apart + 1 + np.maximum(2, self.apart // 4)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, sizes)


def signatures(made: np.ndarray, begin: np.ndarray, bands: Bands, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(signature, row, how many of a row's a partner must share) for some sets of a chunk: of every part,
    in the set's own range of sizes, and then in the one below for those with smaller partners
    there. Empty parts have a signature only in sets where those with shingles settle nothing."""
    sizes = np.diff(begin)
    own = bands.of(sizes)
    rows = rows[sizes[rows] > 0]
    below = rows[(own[rows] > 0) & (-(-bands.percent * sizes[rows] // 100) <= bands.tops[np.maximum(own[rows] - 1, 0)])]
    for who, band in ((rows, own[rows]), (below, own[below] - 1)):
        parts = bands.parts[band]
        base = np.cumsum(parts) - parts
        # Every shingle of every set in `who`.
        many = sizes[who]
        at = np.repeat(begin[who] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        entry = np.repeat(np.arange(len(who)), many)
        cell = base[entry] + (made[at] % parts[entry].astype(np.uint64)).astype(np.int64)
        total = int(parts.sum())
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, cell, mix(made[at] ^ SECOND))
        filled = np.bincount(cell, minlength=total)
        owner = np.repeat(np.arange(len(who)), parts)
        need = np.bincount(owner, weights=filled > 0, minlength=len(who)).astype(np.int64) - bands.apart[band]
        keep = (filled > 0) | (need <= 0)[owner]
        label = (band[owner] << np.int64(40)) + np.arange(total) - base[owner]
        sig = mix(sums + mix(label.astype(np.uint64) + filled.astype(np.uint64) * SECOND))
        yield sig[keep].view(np.int64), who[owner[keep]], np.maximum(need, 0)[owner[keep]]


def described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n, one, two, own, own_need, lower, lower_need): size and 128-bit digest of a text's set, and its
    signatures with the number that a partner must share. Of copies in a task one has signatures, but for
    those met after ``KNOWN`` other sets."""
    bands = Bands(percent)

    def lists(sig, who, need, rows):
        order = np.argsort(who, kind="stable")
        cuts = np.searchsorted(who[order], np.arange(rows + 1))
        first = np.zeros(rows, np.int64)
        first[who] = need
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(sig[order])), pa.array(first)

    def run(batches):
        had: set[int] = set()
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            for first, made, begin in shingles(batch.column(1), width):
                rows = len(begin) - 1
                sizes = np.diff(begin)
                one, two = digests(made, begin)
                here = np.flatnonzero(known[first : first + rows])
                codes, place = np.unique(one[here] ^ mix(two[here]), return_index=True)
                new = [code not in had for code in codes.tolist()]
                had.update(codes.tolist())
                if len(had) > KNOWN:
                    had.clear()
                here = here[place[new]]
                own, lower = (lists(*found, rows) for found in signatures(made, begin, bands, here))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *own, *lower],
                    ["id", "n", "one", "two", "own", "own_need", "lower", "lower_need"],
                )

    return docs.mapInArrow(lean(run), "id long, n long, one long, two long, own array<long>, own_need long, lower array<long>, lower_need long")


def candidates(sets: DataFrame) -> DataFrame:
    """(node, component): groups of sets that share signatures, by half of their digest. (Two sets with
    the same half are in one group, which only makes it larger.)"""
    code = lambda column, kind: (F.col(column) * 2 + kind).alias("need")
    rows = sets.select(F.col("one").alias("node"), F.explode("own").alias("sig"), code("own_need", 0))
    rows = rows.unionAll(sets.select(F.col("one").alias("node"), F.explode("lower").alias("sig"), code("lower_need", 1)))
    same = Window.partitionBy("sig")
    met = rows.withColumn("low", F.min("node").over(same)).withColumn("high", F.max("node").over(same))
    met = staged(met.where("low < high").select("sig", "node", "need").distinct(), "shared")
    enough = met.groupBy("node", "need").count().where(F.col("count") * 2 >= F.col("need") - F.col("need") % 2)
    kept = met.join(enough.select("node").distinct(), "node", "left_semi").withColumn("low", F.min("node").over(same))
    return staged(components(kept.select(F.col("node").alias("a"), F.col("low").alias("b"))), "groups")


class Lists:
    """Inverted lists of the shingles of some sets, by place in the order of size."""

    def __init__(self, flat: np.ndarray, position: np.ndarray, n: int):
        _, token, counts = np.unique(flat, return_inverse=True, return_counts=True)
        shared = counts[token] > 1
        token, position = token[shared], position[shared]
        self.n, kinds = n, len(counts)
        self.token, self.begin = token, np.searchsorted(position, np.arange(n + 1))
        many = np.bincount(token, minlength=kinds)
        self.common = 2 * many > n  # listed by who lacks it
        order = np.lexsort((position, token))
        entries, of = position[order], token[order]
        self.head = np.zeros(kinds + 1, np.int64)
        self.size = np.where(self.common, n - many, many)
        np.cumsum(self.size, out=self.head[1:])
        self.entries = np.empty(int(self.head[-1]), np.int64)
        rare = ~self.common[of]
        starts = np.cumsum(many) - many
        self.entries[self.head[of[rare]] + np.flatnonzero(rare) - starts[of[rare]]] = entries[rare]
        shared = np.flatnonzero(self.common)
        for at in range(0, len(shared), max(1, PROBES // n)):
            some = shared[at : at + max(1, PROBES // n)]
            lacks = np.ones((len(some), n), bool)
            of_some = np.flatnonzero(~rare & (of >= some[0]) & (of <= some[-1]))
            lacks[np.searchsorted(some, of[of_some]), entries[of_some]] = False
            self.entries[self.head[some[0]] : self.head[some[-1] + 1]][np.repeat(self.common[some[0] : some[-1] + 1], self.size[some[0] : some[-1] + 1])] = np.nonzero(lacks)[1]
        self.keys = np.repeat(np.arange(kinds), self.size) * np.int64(n) + self.entries
        self.had = np.zeros(kinds, np.int64)  # earlier sets that have the shingle

    def own(self, x: int) -> np.ndarray:
        return self.token[self.begin[x] : self.begin[x + 1]]

    def before(self, tokens: np.ndarray, x: int) -> np.ndarray:
        """How many entries of some lists are sets before x."""
        return np.where(self.common[tokens], x - self.had[tokens], self.had[tokens])

    def merged(self, tokens: np.ndarray, x: int) -> np.ndarray:
        """The entries of some lists that are sets before x."""
        take = self.before(tokens, x)
        edge = np.cumsum(take) - take
        return self.entries[np.repeat(self.head[tokens] - edge, take) + np.arange(int(take.sum()))]

    def counted(self, tokens: np.ndarray, places: np.ndarray, x: int) -> np.ndarray:
        """How many of some lists each place before x is in: by binary search, or, where that is less to
        look at, by going through the lists."""
        made = np.zeros(len(places), np.int64)
        if not len(tokens) or not len(places) or not len(self.keys):
            return made
        if int(self.before(tokens, x).sum()) + x < len(tokens) * len(places):
            return np.bincount(self.merged(tokens, x), minlength=x)[places]
        step = max(1, PROBES // len(tokens))
        for at in range(0, len(places), step):
            wanted = tokens[:, None] * np.int64(self.n) + places[None, at : at + step]
            found = np.searchsorted(self.keys, wanted)
            made[at : at + step] = (self.keys[np.minimum(found, len(self.keys) - 1)] == wanted).sum(0)
        return made


def search(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For places x in ``sets``, all earlier ones (by size) that link with x: every link once. With ``side``,
    only pairs of different sides are looked for."""
    n = len(sets)
    if n < 2:
        return
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    lists = Lists(np.concatenate([sets[i] for i in order]), np.repeat(np.arange(n), sizes), n)
    at_side = None if side is None else side[order]
    for x in range(n):
        size = int(sizes[x])
        need = max(1, -(-percent * size // 100))  # no partner is larger, so the union is not smaller
        first = int(np.searchsorted(sizes, -(-percent * size // 100)))  # smaller sets cannot link
        mine = lists.own(x)
        # Only shingles that an earlier set has can be in common.
        mine = mine[lists.had[mine] > 0]
        if first < x and len(mine) >= need:
            lengths = lists.before(mine, x)
            mine = mine[np.argsort(lengths, kind="stable")]
            long = min(need - 1, int(need / (MU * math.log2(int(lengths.max()) + 2) + 1)))
            short, probe = mine[: len(mine) - long], mine[len(mine) - long :]
            lacked = lists.common[short]
            base = int(lacked.sum())
            if base:  # all earlier sets start from those
                seen = np.full(x, base, np.int64)
                seen -= np.bincount(lists.merged(short[lacked], x), minlength=x)
                seen += np.bincount(lists.merged(short[~lacked], x), minlength=x)
                found = first + np.flatnonzero(seen[first:] >= need - long)
                seen = seen[found]
            else:
                # Merge the short lists: sorted runs, merged by a stable sort.
                merged = np.sort(lists.merged(short, x), kind="stable")
                found, seen = np.unique(merged, return_counts=True)
                fits = (found >= first) & (seen >= need - long)
                found, seen = found[fits], seen[fits]
            if at_side is not None:
                other = at_side[found] != at_side[x]
                found, seen = found[other], seen[other]
            both = seen + lists.common[probe].sum()
            for lacked in (False, True):
                some = probe[lists.common[probe] == lacked]
                both += (-1 if lacked else 1) * lists.counted(some, found, x)
            linked = found[100 * both >= percent * (size + sizes[found] - both)]
            if len(linked):
                yield int(order[x]), order[linked]
        lists.had[lists.own(x)] += 1


def connections(links: Iterator[tuple[int, np.ndarray]], weights: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of all links those that connect what they connect, and the sum of the partners' weights for each set."""
    group = np.arange(len(weights))
    many = np.zeros(len(weights), np.int64)
    kept = []
    for x, linked in links:
        many[x] += weights[linked].sum()
        many[linked] += weights[x]
        groups, first = np.unique(group[linked], return_index=True)
        for g, k in zip(groups.tolist(), first.tolist(), strict=True):
            if g != group[x]:
                kept.append((x, int(linked[k])))
                group[group == g] = group[x]
    return kept, many


def digests(made: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    one, two = (np.zeros(len(begin) - 1, np.uint64) for _ in range(2))
    np.add.at(one, row, mix(made))
    np.add.at(two, row, mix(made ^ SECOND))
    return one, two


def links_of(ids: list[int], sets: list[np.ndarray], sides: list[int] | None, weights: list[int], percent: int) -> pa.RecordBatch:
    """(a, b, links) of the sets of a tile."""
    side = None if sides is None else np.array(sides)
    pairs, many = connections(search(sets, percent, side), np.array(weights, np.int64))
    own = np.flatnonzero(many).tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[a] for a, _ in pairs] + [ids[a] for a in own], pa.int64()),
            pa.array([ids[b] for _, b in pairs] + [None] * len(own), pa.int64()),
            pa.array([None] * len(pairs) + many[own].tolist(), pa.int64()),
        ],
        ["a", "b", "links"],
    )


def written_parts(rows: DataFrame, width: int) -> str:
    """The folder of the sets (id, weight, made) of rows (grp, part, id, one, two, weight, text), in folders
    of its own each part of a group. Of rows with one id, what has not the set that was asked for is left out."""

    def run(batches):
        key, had = None, set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            own, one, two = (batch.column(c).to_pylist() for c in range(2, 5))
            for first, made, begin in shingles(batch.column(6), width):
                found = [d.view(np.int64).tolist() for d in digests(made, begin)]
                take = []
                for r in range(len(begin) - 1):
                    k = first + r
                    if keys[k] != key:
                        key, had = keys[k], set()
                    name = (own[k], one[k], two[k])
                    if name not in had and (found[0][r], found[1][r]) == name[1:]:
                        had.add(name)
                        take.append(r)
                kept = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(made.view(np.int64))).take(pa.array(take, pa.int64()))
                rest = [batch.column(c).slice(first, len(begin) - 1).take(pa.array(take, pa.int64())) for c in (0, 1, 2, 5)]
                yield pa.RecordBatch.from_arrays([*rest, kept], ["grp", "part", "id", "weight", "made"])

    dealt = rows.repartition(parallelism(rows.sparkSession), "grp", "part").sortWithinPartitions("grp", "part", "id")
    columns = ["grp", "part", "id", "one", "two", "weight", "text"]
    made = dealt.select(*columns).mapInArrow(lean(run), "grp long, part int, id long, weight long, made array<long>")
    return stored.written(made, "llm-parts", "grp", "part")


def searched_parts(tiles: DataFrame, folder: str, percent: int) -> DataFrame:
    """What ``searched`` finds, of tiles (grp, i, j) of the parts in a folder. A task holds two parts."""

    def held(grp, part):
        ids, weights, sets = [], [], []
        for name in stored.under(f"{folder}/grp={grp}/part={part}"):
            for batch in stored.batches(name, ["id", "weight", "made"], 1_000):
                ids += batch.column(0).to_pylist()
                weights += batch.column(1).to_pylist()
                lists = batch.column(2)
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
                sets += [flat[a:b].copy() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return ids, weights, sets

    def run(batches):
        key, left = None, None
        for batch in batches:
            for grp, i, j in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if key != (grp, i):
                    key, left = (grp, i), held(grp, i)
                right = ([], [], []) if i == j else held(grp, j)
                ids, weights, sets = (a + b for a, b in zip(left, right, strict=True))
                sides = None if i == j else [0] * len(left[0]) + [1] * len(right[0])
                if len(sets) > 1:
                    yield links_of(ids, sets, sides, weights, percent)

    # Tiles of one part follow each other, so that a task reads it once.
    tasks = parallelism(tiles.sparkSession)
    dealt = tiles.select("grp", "i", "j").repartitionByRange(tasks, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return dealt.mapInArrow(lean(run), "a long, b long, links long")


def searched(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, links) of the texts of rows (grp, i, j, part, id, one, two, weight, text): pairs a, b that connect
    all texts linked in a tile, and for each text (b null) the weights of those it links with. A tile
    (i, i) has all pairs of its texts, (i, j) those of different parts. Rows of a tile follow each
    other in a partition; of those with one id, what has not the set that was asked for is left out."""

    def run(batches):
        key, ids, sets, sides, weights, had = None, [], [], [], [], set()

        def flush():
            return links_of(ids, sets, sides if key and key[1] != key[2] else None, weights, percent)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            part, own, one, two, weight = (batch.column(c).to_pylist() for c in range(3, 8))
            for first, made, begin in shingles(batch.column(8), width):
                found = [d.view(np.int64).tolist() for d in digests(made, begin)]
                for r in range(len(begin) - 1):
                    k = first + r
                    if keys[k] != key:
                        if len(sets) > 1:
                            yield flush()
                        key, ids, sets, sides, weights, had = keys[k], [], [], [], [], set()
                    name = (own[k], one[k], two[k])
                    if name in had or (found[0][r], found[1][r]) != name[1:]:
                        continue
                    had.add(name)
                    ids.append(own[k])
                    weights.append(weight[k])
                    sets.append(made[begin[r] : begin[r + 1]].copy())
                    sides.append(part[k])
        if len(sets) > 1:
            yield flush()

    tiled = rows.repartition(parallelism(rows.sparkSession), "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    columns = ["grp", "i", "j", "part", "id", "one", "two", "weight", "text"]
    return tiled.select(*columns).mapInArrow(lean(run), "a long, b long, links long")


def _found(members: DataFrame, totals: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, links) of all groups (grp, parts): members are (grp, parts, part, id, one, two, weight, text)."""

    def in_tiles(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return rows.select("grp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "one", "two", "weight", "text")

    large = totals.where("parts > 1")
    if large.isEmpty():
        return searched(in_tiles(members), width, percent)
    folder = written_parts(members.where("parts > 1"), width)
    if not stored.readable(folder):
        return searched(in_tiles(members), width, percent)
    tiles = large.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("parts") - 1)))
    found = searched(in_tiles(members.where("parts = 1")), width, percent)
    return found.unionAll(searched_parts(tiles, folder, percent))


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row.

    Words are runs without ASCII white space, A-Z in lower case. ``n_links`` counts the other documents that
    a text links with, all copies included. Null or empty text has no shingles and links with nothing;
    nor does a row without an id, whose component and links are null. Rows that repeat an id are one
    document: where their texts differ, it is linked with what any of them links with, and each
    row has the links of its own text.
    """
    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    sets = staged(described(picked, width, percent), "sets")
    real = sets.where("n > 0 AND id IS NOT NULL")
    # Exact copies of a set: the smallest id stands for them.
    first = real.groupBy("n", "one", "two").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("weight"))
    first = staged(first, "first")
    groups = candidates(real).select(F.col("node").alias("one"), F.col("component").alias("grp"))
    release(docs.sparkSession)  # the signatures' shuffle is the largest
    members = first.join(groups, "one").select("grp", F.col("rep").alias("id"), "n", "one", "two", "weight")
    totals = members.groupBy("grp").agg(F.sum("n").alias("total"), F.count("*").alias("many")).where("many > 1")
    totals = staged(totals.select("grp", F.ceil(F.col("total") / PART).cast("int").alias("parts")), "totals")
    part = F.pmod(F.xxhash64("one", "two"), F.col("parts")).cast("int")
    cut = members.join(totals, "grp").withColumn("part", part)
    # Only texts of groups go on; all are shuffled for that once.
    found = staged(_found(staged(cut.join(picked, "id"), "members"), totals, width, percent), "found")
    linked = components(found.where("b IS NOT NULL").select("a", "b"))
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = first.join(linked.withColumnRenamed("node", "rep"), "rep", "left").join(counted, "rep", "left")
    links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    classes = classes.select("n", "one", "two", F.coalesce("component", "rep").alias("component_id"), links.alias("n_links"))
    out = sets.select("id", "n", "one", "two").join(classes, ["n", "one", "two"], "left")
    lone = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id"))
    links = F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0)))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), lone.alias("component_id"), links.alias("n_links"))


def without_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those whose component has a smaller id."""
    gone = jaccard_classes(docs, width, percent, id_col, text_col).where("doc_id > component_id")
    gone = gone.select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
