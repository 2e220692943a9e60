import hashlib
import random
import re

import pytest

from kindred.llm import infill, queries

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc, text):
    text = text or ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    units = UNITS.findall(text)
    n = len(units)
    h = [int(sha(f"42:{doc}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    if doc is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc, n, form, len(p), len(m), sha(out), sha(text))


def make_rows():
    pick = random.Random(7)
    bits = ["word", "é", "日本", "x" * 30, "<", "<S", "<P", "M>", "😀", "\xa0"]
    rows = []
    for k in range(200):
        text = "".join(pick.choice(bits) + pick.choice(["", " ", "\n ", "\t\x0b"]) for _ in range(pick.randint(0, 60)))
        rows.append((k, pick.choice(["", " "]) + text + pick.choice(["", "  "])))
    rows += [(900 + k, t) for k, t in enumerate([None, "", " ", "<P>", "a <M> b", "w " * 40_000, "x" * 300_000, "é " * 600_000 + " ", " " * 200_000 + "end"])]
    return [*rows, rows[3], (None, "no id"), (4, "another text")]


@pytest.mark.parametrize("frame", [16, 1 << 16])
def test_query(spark, docs_of, tmp_path, monkeypatch, frame):
    monkeypatch.setattr(infill.store, "__defaults__", (frame, *infill.store.__defaults__[1:]))
    rows = make_rows() if frame > 16 else [r for r in make_rows() if len(r[1] or "") < 3000]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.op13_fill_in_middle(spark, str(tmp_path))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = list(map(tuple, made.collect()))
    assert sorted(map(repr, got)) == sorted(repr(brute(d, t)) for d, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back(docs_of):
    rows = make_rows()
    stored = infill.store(docs_of(rows), 1000)
    for r in stored.collect():
        assert r.before == sorted(r.before) and sum(r.chars) == len(b"".join(map(infill.unpacked, r.frames)).decode())
    back = infill.texts(infill.restored(infill.infilled(stored, seed="7", rate=100, suffix_first=30)))
    assert sorted((repr((r.doc_id, r.text)) for r in back.collect())) == sorted(repr((d, t or "")) for d, t in rows)
    assert infill.restored(infill.infilled(stored.limit(0))).count() == 0


def test_marks_across_frames():
    for out in ("<P>abc<S>d<Se<<S<M>xyz", "<P><S><M>", "<P><<S>S><S<M>P>"):
        p, s, m = re.fullmatch(r"<P>(.*?)<S>(.*?)<M>(.*)", out).groups()
        for size in range(1, 8):
            frames = [infill.packed(out[k : k + size].encode()) for k in range(0, len(out), size)]
            got = infill.parted(frames, ("<P>", "<S>", "<M>"))
            assert {k: b"".join(map(infill.unpacked, v)).decode() for k, v in got.items()} == {"<P>": p, "<S>": s, "<M>": m}
