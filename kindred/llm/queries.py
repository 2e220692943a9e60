"""The registered queries of these operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import bpe, harmonic, infill, interpolation, jaccard, licences, near_vectors, packing, periodic, pii, repeats, topk, toxicity
from kindred.llm.common import staged, table


def tokenizer(name: str) -> str:
    """Where the installed tokenizer files are; the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = repeats.removed(table(spark, sf, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf, "labels")))


def op3_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf, "embeddings"), threshold=0.95)


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), limit=2048)


def op5_licences(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = licences.runs(docs)
    return licences.licensed(docs, licences.train(docs, found=found), found=found)


def op6_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf, "documents"), width=4, percent=85)


def op8_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return interpolation.scored(table(spark, sf, "documents"))


def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.summarise(table(spark, sf, "documents"))


def op11_harmonic_packing(spark: SparkSession, sf: str) -> DataFrame:
    return harmonic.pack(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), limit=2048)


def repeating_end(doc: int | None, n: int) -> np.ndarray | None:
    """For one id in ten, by its CRC-32: from some word on, the text repeats the words found there."""
    if doc is None or not n or zlib.crc32(str(doc).encode()) % 10:
        return None
    pick = zlib.crc32(str(doc).encode()) // 10
    first = pick % n
    period = 1 + (n - first) // (3 + pick % 8)
    at = np.arange(n)
    at[first:] = first + (at[first:] - first) % period
    return at


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf, "documents"), least=24, times=3, places=repeating_end)
    # Runs come by start and period, so of equal ones the first stays. Exponents are compared exactly.
    more = lambda best, run: run.length * best.period > best.length * run.period
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, run: F.when(more(best, run), run).otherwise(best))
    line = lambda run: F.concat(F.concat_ws(",", *[run[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    rows = found.select("doc_id", "runs", best.alias("best"), "collapsed")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    stored = staged(infill.store(table(spark, sf, "documents")), "frames")
    rows = infill.restored(infill.infilled(stored, seed="42", rate=50, suffix_first=80))
    return infill.digested(rows, output="output_sha256", text="restored_sha256")


QUERIES = [
    op1_suffix_dedup, op2_toxicity, op3_embedding_dedup, op4_packing, op5_licences,
    op6_topk, op7_jaccard, op8_lm_scores, op9_bpe, op10_pii,
    op11_harmonic_packing, op12_periodic_runs, op13_fill_in_middle,
]

TWINS = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        f AS (SELECT doc_id, q, substr(h, 2 * q + 1, 1198) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 500)) AS q FROM d)),
        s AS (SELECT doc_id, part, q, unnest(range(0, least(500, length(part) // 2 - 99))) AS i FROM f),
        w AS (SELECT doc_id, q + i AS p, row_number() OVER (PARTITION BY md5(substr(part, 2 * i + 1, 200)) ORDER BY doc_id, q + i) AS n FROM s),
        r AS (SELECT doc_id, p, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w WHERE n > 1),
        g AS (SELECT doc_id, p, sum(CASE WHEN reach >= p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
        c AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, run),
        k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM c),
        j AS (SELECT k.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept,
              sum(b - a) AS removed, count(*) AS runs FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN j ON d.doc_id = j.doc_id""",
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        ok AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
                  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT low.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, low.a = component_id AS kept FROM low LEFT JOIN n ON low.a = n.a""",
    "op6_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        c AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT reach.a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, coalesce(any_value(n_links), 0) AS n_links
        FROM reach LEFT JOIN n ON a = n.doc_id LEFT JOIN c ON reach.a = c.a GROUP BY reach.a""",
    "op12_periodic_runs": r"""
        WITH t AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                       lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS h FROM documents),
        g AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
        p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM g),
        o AS (SELECT k, doc_id, n, i, w[1 + CASE WHEN p IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
        e AS (SELECT x.k, x.i, y.i - x.i AS q FROM o x JOIN o y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
        s AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS run FROM e) GROUP BY k, q, run
              HAVING count(*) + q >= greatest(24, 3 * q)),
        r AS (SELECT k, start, length, min(q) AS period FROM s GROUP BY k, start, length),
        b AS (SELECT k, count(*) AS n_runs, first(start ORDER BY length / period DESC, start, period) AS start, first(length ORDER BY length / period DESC, start, period) AS length,
              first(period ORDER BY length / period DESC, start, period) AS period, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY k),
        c AS (SELECT o.k, string_agg(word, ' ' ORDER BY i) AS words FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = o.k AND o.i >= r.start + r.period AND o.i < r.start + r.length) GROUP BY o.k)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
        FROM t LEFT JOIN b ON t.k = b.k LEFT JOIN c ON t.k = c.k""",
    "op13_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS s FROM documents),
        h AS (SELECT doc_id, x, u, len(u) AS n, list_transform(range(4), lambda k: ('0x' || substr(s, 8 * k + 1, 8))::BIGINT) AS h FROM t),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
              CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM p""",
}
