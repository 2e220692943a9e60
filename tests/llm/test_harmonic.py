import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kindred.llm import harmonic

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(got, rows, limit):
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for doc, text in rows:
        want.setdefault(doc, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    places, total = {}, {}
    for r in got:
        (ids, *_) = [ids for ids in want[r.doc_id] if len(ids) == r.doc_tokens]
        assert r.length > 0 and r.start + r.length <= r.doc_tokens
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total.setdefault(r.doc_id, Counter()).update(range(r.start, r.start + r.length))
    for doc, own in want.items():
        assert total[doc] == Counter(k for ids in own for k in range(len(ids)))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end == limit or end & (end - 1) == 0 and end < limit  # nothing to pad
    return places


@pytest.mark.parametrize("limit", [64, 100])
def test_pack(docs_of, limit, alternating, monkeypatch):
    monkeypatch.setattr(harmonic, "STRETCH", 2)  # many stretches
    pick = random.Random(5)
    size = lambda: int(pick.lognormvariate(2.5, 1.3))
    texts = ["".join(pick.choice(["the ", "word ", "é", "x1 ", "\n"]) for _ in range(size())) for _ in range(400)]
    rows = [*enumerate(texts), (500, None), (501, ""), (502, "long " * 900), (None, "no id"), (503, "a<|endoftext|>b"), (3, texts[3]), *((600 + k, t) for k, t in enumerate(alternating))]
    made = harmonic.pack(docs_of(rows), PATH, limit)
    places = check(made.collect(), rows, limit)
    assert sum(end < limit for end in (sum(n for _, n in own) for own in places.values())) <= 7
    assert made.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert harmonic.pack(docs_of(rows).limit(0), PATH, limit).count() == 0


def test_equal_lengths_fill_their_class_whole(docs_of):
    """A third of a sequence each: three to a sequence, nothing cut but what fills the last token."""
    rows = [(k, "the " * 19) for k in range(3000)]
    got = harmonic.pack(docs_of(rows), PATH, 64).collect()
    check(got, rows, 64)
    assert Counter(r.length for r in got)[21] > 2900  # only every third leaves one place open


def test_one_document(docs_of):
    for text in ("", "the " * 63, "the " * 64, "the " * 65, "the " * 40):
        check(harmonic.pack(docs_of([(1, text)]), PATH, 64).collect(), [(1, text)], 64)


def test_kept_whole():
    assert harmonic.kept_whole([], 10, 2) == (0, 0)
    assert harmonic.kept_whole([(1, 100, 10)], 10, 2) == (0, 0)  # nothing is left open
    assert harmonic.kept_whole([(1, 90, 10), (5, 20, 2)], 10, 2) == (1, 4)  # 110 tokens fill 11 sequences, 2 are those of class 5
    assert harmonic.kept_whole([(2, 18, 2)], 10, 4) == (2, 0)
