import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from kindred.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_plan_uses_each_piece_once_and_few_sequences():
    pick = random.Random(3)
    for limit, n in ((64, 3000), (2048, 5000), (7, 50)):
        have = Counter(min(limit, max(1, int(pick.lognormvariate(4, 1.2)) % limit + 1)) for _ in range(n))
        made, used = packing.plan(have, limit), Counter()
        for parts, times in made:
            assert times > 0 and sum(length * many for length, many in parts) <= limit
            for length, many in parts:
                used[length] += many * times
        assert used == have
        bound = -(-sum(length * many for length, many in have.items()) // limit)
        assert sum(times for _, times in made) <= 1.02 * bound + 2
    assert packing.plan({}, 2048) == []


def test_pack(docs_of, alternating):
    pick = random.Random(4)
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["".join(pick.choice(["the ", "word ", "é", "x1 ", "\n"]) for _ in range(pick.randint(0, 90))) for _ in range(120)]
    rows = [*enumerate(texts), (500, None), (501, ""), (3, texts[3]), (502, "long " * 700), (None, "no id"), (503, "<|endoftext|>"),
            (504, "a<|endoftext|>b <|endoftext|> <|endoftext|><|endof"), (505, "text|>"), *((600 + k, t) for k, t in enumerate(alternating))]
    limit = 64
    got = packing.pack(docs_of(rows), PATH, limit, with_ids=True).collect()
    want = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % limit or limit
        cuts = [0, *range(first, len(ids), limit), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        assert len(r.ids) == r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= limit
    assert packing.pack(docs_of(rows).limit(0), PATH, limit).count() == 0
