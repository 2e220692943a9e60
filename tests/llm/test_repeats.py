import hashlib
import random

import pytest

from kindred.llm import repeats


def make_rows():
    pick = random.Random(5)

    def some(n):
        return "".join(pick.choice("abcdef é\n") for _ in range(n))

    passages = [some(pick.randint(60, 400)) for _ in range(12)]
    rows = []
    for i in range(120):
        text = "".join(pick.choice([some(pick.randint(0, 120)), pick.choice(passages)]) for _ in range(pick.randint(0, 5)))
        if pick.random() < 0.2 and rows:
            letters = list(rows[pick.randrange(len(rows))][1])
            for _ in range(2):
                if letters:
                    letters[pick.randrange(len(letters))] = pick.choice("xyz")
            text = "".join(letters)
        rows.append((i * 7 % 120 * 2, text))
    return [*rows, (1001, "a" * 700), (1003, "ab" * 400), (1005, None), (1007, ""), (None, passages[0] * 2), rows[7], (1009, "a" * 100), (1011, "é" * 300)]


def brute(rows, length):
    seen, out = set(), {}
    docs = {d: (t or "").encode() for d, t in rows if d is not None}
    for doc in sorted(docs):
        raw, gone = docs[doc], bytearray(len(docs[doc]))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(raw[s : s + length])
        runs = sum(c and not b for b, c in zip(b"\0" + gone, gone, strict=False))
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(x for x, c in zip(raw, gone, strict=True) if not c)).hexdigest())
    return out


@pytest.mark.parametrize(("chunk", "sort", "length"), [(1 << 21, 1 << 21, 100), (1500, 1200, 100), (4000, 900, 30)])
def test_removed(docs_of, chunk, sort, length, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(repeats, "SORT_BYTES", sort)
    rows = make_rows()
    want = brute(rows, length)
    got = repeats.removed(docs_of(rows), length).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_texts_are_cut_at_characters(docs_of):
    rows = make_rows()
    docs = docs_of(rows)
    kept = repeats.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    by_id = {r.doc_id: r for r in kept.collect()}
    assert by_id[1005].text is None and by_id[1007].text == "" and by_id[1009].text == ""
    assert by_id[1001].text == "a" and set(by_id[1011].text) == {"é"}
    assert repeats.removed(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("split", "chunk"), [(0, 1 << 20), (0, 1500), (32, 4000)])
def test_keys_with_many_phrases_are_split(docs_of, split, chunk, monkeypatch):
    """A line that most texts begin with: no key keeps a phrase of each of them, and the result is the same."""
    monkeypatch.setattr(repeats, "SPLIT", split)
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    tables, stage = {}, repeats.staged
    monkeypatch.setattr(repeats, "staged", lambda rows, name: tables.setdefault(name, stage(rows, name)))
    pick = random.Random(4)
    line = "".join(pick.choice("abcdefgh ") for _ in range(150))
    own = lambda: "".join(pick.choice("ijklmnop") for _ in range(200))
    rows = [*make_rows(), *((2000 + i, (own() if i % 3 == 0 else "") + line + own()) for i in range(300))]
    want = brute(rows, 100)
    for r in repeats.removed(docs_of(rows), 100).collect():
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    mixed = tables["parse"].where(f"offset <> {repeats.REPEAT}").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert (mixed or 0) <= split


def test_an_id_with_several_texts(docs_of):
    """One of the texts stands for the id; the others are left whole and cut nothing from other documents."""
    long, other = "".join(f"passage {k} " for k in range(40)), "".join(f"another {k} " for k in range(40))
    rows = [(1, long), (3, long[:300]), (3, ""), (3, other), (4, other), (5, None), (5, "")]
    got = repeats.removed(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by_text = {(r.doc_id, r.n_bytes): r for r in got}
    stands = [n for n in (300, 0, len(other)) if by_text[3, n].n_removed or n == 0]
    assert sum(by_text[3, n].n_removed > 0 for n in (300, 0, len(other))) <= 1 and by_text[3, 0].n_removed == 0
    for n, text in ((300, long[:300]), (0, ""), (len(other), other)):
        r = by_text[3, n]
        kept = "" if r.n_removed else text
        assert r.n_removed in (0, n) and r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert stands and by_text[1, len(long)].n_removed == 0
    docs = docs_of(rows)
    texts = sorted((r.doc_id, r.text or "") for r in repeats.without_repeats(docs).collect())
    assert [t for d, t in texts if d == 1] == [long] and len(texts) == len(rows)
