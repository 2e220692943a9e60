import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from kindred.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", " a", "É", "ß", "1", "٣", "!", "-", "\xa0", "　", "é", "日本", "'re", "'S", "😀", "xxx"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})


def random_texts(n):
    pick = random.Random(1)
    return ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 40))) for _ in range(n)]


def test_ids_are_those_of_the_library(library):
    texts = [*random_texts(3000), "", "a" * 3000, " " * 500, "'" * 300 + "s", "ab" * 2000]
    made, found = bpe.codec(PATH), []
    for chunk in bpe.chunks(pa.array(texts)):
        flat, edges = chunk.ids(made.pieces)
        found += [flat[edges[a] : edges[b]].tolist() for a, b in zip(chunk.rows[:-1], chunk.rows[1:], strict=True)]
    assert found == [library.encode_ordinary(t) for t in texts]


def test_long_pieces_merge_alike():
    ranks = bpe.ranks_of(PATH)
    piece = b"abcabdhello worldthe" * 40
    assert bpe.merge(piece, ranks) == bpe._merge_long([piece[i : i + 1] for i in range(len(piece))], ranks)


def test_round_trip(docs_of, library, alternating):
    rows = [(300, alternating[0]), (301, alternating[1]), *enumerate(random_texts(60)), (100, None), (101, ""), (7, random_texts(60)[7]), (None, "null id")]
    docs = docs_of(rows)
    for r in bpe.round_trip(docs, PATH).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe.encode(docs, PATH)
    assert {(r.id, bytes(r.data).decode()) for r in bpe.decode(encoded, PATH).collect()} == {(d, t or "") for d, t in rows}
    for r in encoded.collect():
        sizes = [len(bpe.codec(PATH).bytes[i]) for i in r.ids]
        assert r.starts == [sum(sizes[:k]) for k in range(len(sizes))]
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_slices_are_compared_by_their_bytes(library, alternating, monkeypatch):
    text = "one two three one two four " + " ".join(alternating) + " " + "x" * 100 + " " + "x" * 99 + "y"
    monkeypatch.setattr(bpe, "slice_codes", lambda held, starts, ends: starts * 0)  # every slice has one hash
    (chunk,) = bpe.chunks(pa.array([text]))
    assert chunk.ids(bpe.codec(PATH).pieces)[0].tolist() == library.encode_ordinary(text)
