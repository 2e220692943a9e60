import random
import re

import numpy as np
import pytest

from kindred.llm import jaccard


def make_rows():
    pick = random.Random(3)
    base = [" ".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (3, 5, 8, 12, 30, 60, 120) * 2]
    rows = []
    for text in base:
        for _ in range(9):
            words = text.split()
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3])):
                words[pick.randrange(len(words))] = pick.choice("ABCDEFGXYZ")
            rows.append((len(rows), " ".join(words[: len(words) - (pick.random() < 0.3)]) + pick.choice(["", " ", "\n"])))
    n = len(rows)
    return [*rows, (n, ""), (n + 1, None), (n + 2, " \n"), (None, base[3]), (5, rows[5][1]), (n + 3, "É a"), (n + 4, "é a"), (n + 5, "É A")]


def sets_of(rows, width):
    sets = {}
    for doc, text in rows:
        if doc is not None:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            words = re.findall(r"[^\x20\x09-\x0D]+", low)
            sets[doc] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    return sets


def brute_links(rows, width, percent):
    sets = sets_of(rows, width)
    like = lambda a, b: a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    return {a: sum(bool(like(a, b)) for b in sets) for a in sets}


def brute(rows, width, percent):
    sets = sets_of(rows, width)
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("width", "percent", "part"), [(4, 85, 1 << 20), (5, 80, 200), (1, 60, 1 << 20)])
def test_classes(docs_of, width, percent, part, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", part)
    rows = make_rows()
    want, links = brute(rows, width, percent), brute_links(rows, width, percent)
    got = jaccard.jaccard_classes(docs_of(rows), width, percent).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.n_links == links[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


@pytest.mark.parametrize(("kinds", "own", "percent"), [(6, 37, 70), (1, 37, 70), (1, 39, 90), (3, 30, 50)])
@pytest.mark.parametrize("sides", [False, True])
def test_search_finds_each_link_once(kinds, own, percent, sides, monkeypatch):
    monkeypatch.setattr(jaccard, "PROBES", 300)
    pick = random.Random(6)
    base = [pick.sample(range(1000), 40) for _ in range(kinds)]
    sets = [np.array(sorted({*pick.sample(pick.choice(base), pick.randint(own - 5, own)), pick.randrange(1000, 1050)}), np.uint64) for _ in range(80)]
    sets += [np.array([k], np.uint64) for k in (5000, 5001)]
    side = np.arange(len(sets)) % 2 if sides else None
    found = [(min(x, int(y)), max(x, int(y))) for x, linked in jaccard.search(sets, percent, side) for y in linked]
    want = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and (not sides or a % 2 != b % 2):
                want.add((a, b))
    assert sorted(found) == sorted(want) and want
    weights = np.arange(1, len(sets) + 1)
    kept, many = jaccard.connections(jaccard.search(sets, percent, side), weights)
    assert set((min(p), max(p)) for p in kept) <= want and len(kept) < len(sets)
    up = list(range(len(sets)))
    for a, b in kept:
        up = [up[a] if u == up[b] else u for u in up]
    assert all(up[a] == up[b] for a, b in want)
    for a in range(len(sets)):
        assert many[a] == sum(weights[x + y - a] for x, y in want if a in (x, y))


def test_links_are_counted_for_all_copies(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 50)
    words = [f"w{k}" for k in range(40)]
    near = lambda k: " ".join([*words[:k], "other", *words[k + 1 :]])
    rows = [(k, " ".join(words)) for k in range(50)] + [(100 + k, near(k)) for k in (0, 39)] + [(7, near(39)), (500, "nothing like it at all")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.n_links) for r in jaccard.jaccard_classes(docs_of(rows), 4, 85).collect()}
    assert len(got) == 54 - 1  # both texts of 7 have as many shingles
    assert got[0, 37][0] == got[100, 37][0] == got[139, 37][0] == 0 and got[500, 2] == (500, 0)
    assert got[0, 37][1] == 49 + 1 + 2 and got[100, 37][1] == 50 + 2


def test_one_of_each_group_stays(docs_of):
    rows = make_rows()
    docs = docs_of(rows)
    kept = jaccard.without_copies(docs)
    assert kept.columns == docs.columns
    want = brute(rows, 5, 80)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, _ in rows if d is not None and want[d][1] == d)
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0


def test_words_that_look_alike_to_a_sum_of_powers(docs_of, alternating):
    docs = docs_of([(1, alternating[0]), (2, alternating[1]), (3, alternating[0])])
    assert {tuple(r) for r in jaccard.jaccard_classes(docs, 4, 85).collect()} == {(1, 1, 1, 1), (2, 1, 2, 0), (3, 1, 1, 1)}
