import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def docs_of(spark):
    """A table of documents, with columns of the caller that clash with names used inside."""

    def make(rows, parts=3):
        wide = [(d, t, "en", "s", None if t is None else len(t), 1, "x") for d, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, id int, spans string"
        return spark.createDataFrame(wide, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def alternating():
    """Two texts that sums of powers modulo 2^64 cannot tell apart, whatever their odd base: letters by
    the parity of the set bits of their place, and the same with the letters exchanged."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(1 << 10))
    return word, word.translate(str.maketrans("ab", "ba"))
