"""The pipeline's stages against brute force on their own input, and the queries against SQL."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_jaccard import brute as brute_classes
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from checks.compare import compare, connect
from kindred.llm import pii, toxicity

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_queries_are_registered():
    names = set(driver.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


@pytest.mark.parametrize("name", [n for n in driver.queries() if n.startswith("op") and n in driver.oracle_sql()])
def test_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, SF_DIR) is None


def without_repeats(rows, length=100):
    """Texts by id without what stands earlier; a character goes only with all its bytes."""
    seen, out = set(), {}
    for doc, text in sorted({d: t or "" for d, t in rows if d is not None}.items()):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            part = raw[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(part)
        kept, at = [], 0
        for c in text:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                kept.append(c)
            at += size
        out[doc] = "".join(kept)
    return out


def packed_rows(rows, limit=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % limit or limit, len(ids), limit), len(ids)]
        out += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(out, key=repr)


def check_stages(spark, docs, sf_dir):
    """Each stage's rows are those that brute force makes of its input; the last stage's input too."""
    rows, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir)
        rows = spark.createDataFrame(out.collect(), out.schema)
        seen.append(rows)
    given = docs.collect()
    toxic, unique, cut, private, packed = (t.collect() for t in seen)
    assert all(t.columns == docs.columns for t in seen[:4])
    by = lambda own: sorted(map(repr, own))
    pairs = lambda own: [(r.doc_id, r.text) for r in own]

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels)
    low = [r for r in given if model.score(np.array([model.counts(r.text)]))[0] < 0.3]
    assert by(toxic) == by(low)

    classes = brute_classes(pairs(toxic), 5, 80)
    assert by(unique) == by(r for r in toxic if r.doc_id is None or classes[r.doc_id][1] == r.doc_id)

    texts = without_repeats(pairs(unique))
    want = [r.text if r.doc_id is None or r.text is None else texts[r.doc_id] for r in unique]
    assert sorted(map(repr, pairs(cut))) == sorted(repr((r.doc_id, t)) for r, t in zip(unique, want, strict=True))

    assert sorted(map(repr, pairs(private))) == sorted(repr((r.doc_id, pii.mask(r.text) if r.text else r.text)) for r in cut)
    for own in (cut, private):
        assert all(r.text is None or r.n_chars == len(r.text) for r in own)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=repr) == packed_rows(pairs(private))
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    return [len(t) for t in (given, toxic, unique, cut)]


def test_stages(spark):
    counts = check_stages(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), SF_DIR)
    assert counts[0] > counts[2]


def test_stages_on_odd_rows(spark, docs_of, tmp_path):
    passage = "".join(f"a passage of words number {k}, " for k in range(12))
    rows = [(k, f"document {k} é " + " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(60))) for k in range(30)]
    rows += [(40, None), (41, ""), (42, " \n"), (43, passage + "mail a.b@c.org"), (44, "before " + passage), (45, passage * 3), (46, rows[3][1] + " end")]
    rows += [rows[5], (None, passage), (None, None), (47, "é" * 400), (48, "x" * 1_200_000)]
    docs = docs_of(rows)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = check_stages(spark, docs, str(tmp_path))
    assert counts[0] == len(rows) and counts[2] < counts[0]


def test_no_documents(spark, docs_of, tmp_path):
    docs_of([(1, "a")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    few = docs_of([(1, "one two three"), (2, None)]).select("doc_id", "text")
    assert corpus_pipeline.repeated_passages(spark, few, str(tmp_path)).columns == ["doc_id", "text"]
