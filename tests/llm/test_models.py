"""Toxicity, licences and language-model scores."""

import math
import random
import re
import zlib
from collections import Counter

from kindred.llm import interpolation, licences, toxicity


def test_grammar():
    model = toxicity.Model()
    names = lambda text: {n: int(c) for n, c in zip(toxicity.PATTERNS, model.counts(text), strict=True) if c}
    assert names("What an idiot.") == {"insult": 1}
    assert names("You are an idiot.") == {"directed": 1}
    assert names("Idiot, I mean you.") == {"insult": 1, "directed": 1}
    assert names("They will kill you!") == {"threat": 1}
    assert names("He is not an idiot. A fine day.") == {"negated": 1}
    assert names("She said that idiot left.") == {"reported": 1}
    assert names("a stupid clown") == {"insult": 2, "run": 1}
    assert names("Time to kill an hour.") == {} and names("") == {} and names(None) == {}
    assert names("idiotic") == {}


def test_threats_in_both_orders():
    model = toxicity.Model()
    names = lambda text: {n: int(c) for n, c in zip(toxicity.PATTERNS, model.counts(text), strict=True) if c}
    for text in ("I will kill you", "we will hurt them", "burn her house", "Ich werde dich töten", "je vais te frapper"):
        assert names(text) == {"threat": 1}, text
    assert names("They will kill you and burn it") == {"threat": 2}
    assert names("I will not kill you") == names("You will never hurt them") == {"negated": 1}
    assert names("Bob said we must kill you") == names("You said I must kill them") == {"reported": 1}
    assert names("Kill an hour. You came.") == {}
    assert names("I will kill you, idiot") == {"threat": 1, "directed": 1}


def test_long_clauses_begin_where_they_begin():
    model = toxicity.Model()
    names = lambda text: {n: int(c) for n, c in zip(toxicity.PATTERNS, model.counts(text), strict=True) if c}
    assert names("He said so. " + "word " * 100 + "idiot") == {"insult": 1}
    assert names("You came. " + "word " * 100 + "idiot. Yes. " + "word " * 100 + "scum") == {"insult": 2}


def test_toxicity_is_learnt_in_any_language(docs_of, spark):
    pick = random.Random(8)
    rows, marks = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 7))) for _ in range(30)]
        if toxic:
            words[pick.randrange(30)] = "zworg" + pick.choice(["en", "ter", "lich", "a", "ul"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs = docs_of([*rows, (9000, None), (9001, ""), (None, "you idiot"), rows[6]])
    labels = spark.createDataFrame([*marks, (None, 1), (9000, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert any(s.startswith("zwor") for s in model.stems)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    truth = dict(marks)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.predicted == truth[r.doc_id] for r in held)
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id >= 9000").count() == 2
    none = toxicity.learn(docs.limit(0), labels.limit(0))
    assert toxicity.scored(docs.limit(0), none).count() == 0


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_language_model(docs_of):
    pick = random.Random(9)
    follow = {w: pick.sample("abcdefghijklmnop", 3) for w in "abcdefghijklmnop"}
    rows = []
    for i in range(200):
        word, text = "a", []
        for _ in range(pick.randint(0, 80)):
            word = pick.choice(follow[word])
            text.append(word)
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, ""), (None, "A b c"), rows[4], (902, "É new words")]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(t for d, text in rows if not held(d) for t in tokens(text))
    n, kinds = sum(counts.values()), len(counts)
    got = interpolation.scored(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        own = tokens(dict(rows)[r.doc_id])
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (kinds + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(counts[t] > 0 for t in own), n)
        assert abs(r.base_score - base) < 1e-6
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.75 * sum(r.base_score for r in out)  # pairs tell a lot here
    assert interpolation.scored(docs_of(rows).limit(0)).count() == 0


def test_probabilities_sum_to_one(docs_of):
    """Over every word that can follow, and the words never seen as one."""
    rows = [(i, "a b a c b a" if i % 2 else "b c") for i in range(40)]
    learnt = [t for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    kinds = sorted({w for t in learnt for w in t.split()})
    last = max(d for d, _ in rows)
    probes, d = [], last + 1
    for w in (*kinds, "unseen", ""):
        while zlib.crc32(str(d).encode()) % 5 != 1:
            d += 1
        probes.append((d, w))
        d += 1
    got = {r.doc_id: r for r in interpolation.scored(docs_of([*rows, *probes])).collect()}
    assert all(got[d].held_out for d, _ in probes)
    assert got[probes[-1][0]].score < 0 and got[probes[-2][0]].n_known == 1


def test_licences(docs_of):
    pick = random.Random(11)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(20)) + "."
    notices = {"mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    rows, want = [], {}
    for i in range(150):
        lines = [prose() for _ in range(3)]
        if i % 5 == 1:
            lines.append("The driver's licence was shown at the desk by " + word() + ".")
        if i % 3 == 0:
            family = pick.choice(sorted(notices))
            lines.insert(pick.randrange(4), notices[family])
            want[i] = family
        rows.append((i, "\n".join(lines)))
    docs = docs_of([*rows, (900, None), (901, ""), (None, notices["mit"]), rows[0]])
    model = licences.train(docs)
    got = licences.licensed(docs, model).collect()
    assert len(got) == len(rows) + 4
    assert all(r.families == want.get(r.doc_id, "") for r in got if r.doc_id is not None)
    assert {(r.n_paragraphs, r.n_licence) for r in got if r.doc_id in (900, 901)} == {(0, 0)}
    assert [r.families for r in got if r.doc_id is None] == ["mit"]
    plan = licences.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    empty = docs.limit(0)
    assert licences.licensed(empty, licences.train(empty)).count() == 0


def test_wrapped_notices_count_once(docs_of):
    pick = random.Random(13)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(12)) + "."
    bsd, mpl = licences.NOTICES["bsd"][0], licences.NOTICES["mpl"][0]

    def wrapped(text, n, mark=""):
        own = text.split()
        return "\n".join(mark + " ".join(own[i : i + n]) for i in range(0, len(own), n))

    texts = {0: wrapped(bsd, 7), 1: wrapped(bsd, 2), 2: wrapped(bsd, 1), 3: wrapped(bsd, 3, "    // "), 4: wrapped(bsd, 4) + "\n" + wrapped(mpl, 3)}
    texts |= {5: wrapped(bsd, 5) + "\n\n" + wrapped(bsd, 6), 6: prose() + "\n" + wrapped(mpl, 1) + "\n" + mpl}
    rows = [(i, "\n".join([prose(), texts.get(i, prose()), prose()])) for i in range(150)]
    docs = docs_of(rows)
    got = {r.doc_id: r for r in licences.licensed(docs, licences.train(docs)).collect()}
    assert [got[i].families for i in range(7)] == ["bsd"] * 4 + ["bsd,mpl", "bsd", "mpl"]
    assert [(got[i].n_licence, got[i].n_confirmed) for i in range(4)] == [(1, 1)] * 4
    assert (got[4].n_confirmed, got[5].n_confirmed) == (2, 2)
    assert all(got[i].n_licence == 0 for i in range(7, 150))


def test_runs_of_lines(docs_of):
    texts = {1: "MIT\nand use\n\nof the\nlicense", 2: "of the\nand", 3: "xyzzy\nlicense xyzzy\nwith xyzzy", 4: "", 5: None, 6: "license\n" * 3}
    rows = licences.runs(docs_of(list(texts.items()))).collect()
    got = sorted((r.id, [(x.position, x.cue) for x in r.lines]) for r in rows)
    assert got == [(1, [(0, True), (1, False)]), (1, [(3, False), (4, True)]), (3, [(1, True)]), (6, [(0, True), (1, True), (2, True)])]
    assert got[0][1][0][0] == 0 and {r.lines[0].paragraph for r in rows} == {"MIT", "of the", "license xyzzy", "license"}


def test_licences_without_a_cue_and_over_lines(docs_of):
    pick = random.Random(12)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(12)) + "."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met."
    texts = {0: "Distributed under CC BY-SA 4.0.", 1: "SPDX: GPL-3.0-only", 2: "Dual MIT/Apache-2.0", 3: "GNU LGPL, version 3", 4: bsd, 5: "Released under the MIT License.\n" + prose() + " free software"}
    rows = [(i, "\n".join([prose(), texts.get(i, prose()), prose()])) for i in range(150)]
    docs = docs_of(rows)
    got = {r.doc_id: r for r in licences.licensed(docs, licences.train(docs)).collect()}
    assert [got[i].n_licence for i in range(6)] == [1] * 6
    assert [got[i].families for i in (0, 4, 5)] == ["cc-by-sa", "bsd", "mit"]
    assert all(got[i].n_licence == 0 for i in range(6, 150))


def test_all_unknown_paragraphs_are_learnt_from(docs_of):
    cues = [c for c in licences.CUES if not re.search(licences.COMMON, c)]
    docs = docs_of([(i, f"xyzzy {cue} xyzzy\nxyzzy\nlicence {cue}x") for i, cue in enumerate(cues)] + [(None, "xyzzy mit"), (900, None)])
    rows = licences._examples(docs, "doc_id", "text", 10, licences.runs(docs)).collect()
    rows = [r for r in rows if r.label == len(licences.FAMILIES)]
    # With a bound of ten every cue is there, and the paragraphs weigh as ten.
    assert {t for r in rows for t in r.told} == {*cues, "others 1"}
    assert abs(sum(r.weight for r in rows) - 10) < 1e-9
    assert sum(r.weight for r in rows if r.told == ["others 1"]) == 5.0
