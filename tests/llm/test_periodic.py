import hashlib
import random
import re
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from kindred.llm import periodic, queries


def brute_runs(x, least, times):
    n, found = len(x), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((a, length, q) for (a, length), q in found.items()), key=lambda r: (r[0], r[2]))


def pieces(pick, most):
    x = []
    while len(x) < most:
        unit = [pick.randrange(pick.randint(1, 4)) for _ in range(pick.randint(1, 9))]
        x += (unit * pick.randint(1, 8))[: pick.randint(1, 60)]
    return x


def test_longest_lyndon_words():
    pick = random.Random(1)
    for _ in range(500):
        x = [pick.randrange(pick.randint(1, 4)) for _ in range(pick.randint(1, 40))] if pick.random() < 0.6 else pieces(pick, 50)
        n = len(x)
        want = [next((j for j in range(i + 1, n) if x[j:] < x[i:]), n) - i for i in range(n)]
        assert periodic.lyndon_lengths(x) == want
    assert periodic.lyndon_lengths([]) == []


def test_runs():
    pick = random.Random(2)
    for _ in range(500):
        x = pieces(pick, pick.randint(0, 150))
        for least, times in ((24, 3), (6, 2), (9, 4), (2, 2)):
            assert periodic.runs(np.array(x, np.int64), least, times) == brute_runs(x, least, times)


def test_long_runs():
    x = np.array([*range(1000), *(list(range(700)) * 40), *range(500, 900)], np.int64)
    found = periodic.runs(x)
    assert found == [(1000 - 0, 28000, 700)]
    x = np.arange(100_000) % 12_345
    assert periodic.runs(x) == [(0, 100_000, 12_345)]


def brute_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = queries.repeating_end(doc, len(words))
    words = words if at is None else [words[k] for k in at]
    found = brute_runs(words, 24, 3)
    gone = {k for a, n, p in found for k in range(a + p, a + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc, len(found), *best, milli, sha("".join(f"{a},{n},{p}\n" for a, n, p in found)), sha(kept))


def test_query(spark, docs_of, tmp_path):
    pick = random.Random(3)
    kinds = ["the", "The", "é", "x", "longer-word", "日本"]
    rows = []
    for k in range(150):
        x = pieces(pick, pick.randint(0, 150))
        gaps = [pick.choice([" ", "\n", " \t", "\x0b", "\x0c\r"]) for _ in x]
        rows.append((k, pick.choice(["", "  "]) + "".join(kinds[w] + g for w, g in zip(x, gaps, strict=True))))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a " * 30_000), (904, "word " * 23), (905, "word " * 24), (906, "a\xa0b " * 30), (907, "x " * 600_000)]
    rows += [rows[5], (None, "a b " * 30), (5, "other text of the same id")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.op12_periodic_runs(spark, str(tmp_path))
    assert made.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    small = made.where("doc_id IS NULL OR doc_id NOT IN (903, 907)").collect()
    assert sorted(map(repr, map(tuple, small))) == sorted(repr(brute_row(d, t)) for d, t in rows if d not in (903, 907))
    long = {r.doc_id: r for r in made.where(F.col("doc_id").isin(903, 907)).collect()}
    for doc, n in ((903, 30_000), (907, 600_000)):
        assert tuple(long[doc])[1:6] == (1, 0, n, 1, 1000 * n)
        word = "a" if doc == 903 else "x"
        assert long[doc].collapsed_sha256 == hashlib.sha256(word.encode()).hexdigest()
    assert periodic.periodic_runs(docs_of(rows).limit(0)).count() == 0
