"""Plain SQL with the meaning of the registered queries, over the raw test tables."""

from __future__ import annotations

import re

from kindred.functions.display import JUDGE_PROMPT
from kindred.functions.text import WHITESPACE
from kindred.operators.similarity import overfetch
from kindred.plans.stand_ins import LIBRARY_URL, SQL_VIEWS
from kindred.sources.markup import BOOK_NAMESPACE

K = 10
BULK = 100

VIEWS = {
    **SQL_VIEWS,
    "unit_vectors": """
        SELECT book_id, CAST(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(x / norm AS FLOAT))
                             AS DOUBLE[]) AS vec
        FROM (SELECT *, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]),
                                                CAST(embedding AS DOUBLE[]))) AS norm FROM vectors)""",
    "item_authors": """
        SELECT *, list_filter(list_transform(string_split(author, ','), lambda x: trim(x)),
                              lambda x: x <> '') AS authors
        FROM items""",
    "book_list": """
        SELECT *, list_filter(list_transform(string_split(author, ','), lambda x: trim(x)),
                              lambda x: x <> '') AS authors
        FROM books""",
    "catalogue": """
        SELECT 'a' || p_size || '.zip' AS archive, p_partkey || '.fb2' AS book, p_name AS title,
               p_brand || ' ' || p_type || ', B ' || p_type AS author
        FROM part WHERE p_size % 3 <> 0 AND p_size <> 7""",
    "with_vector": "SELECT * FROM books WHERE id IN (SELECT book_id FROM vectors)",
    "names": "SELECT id AS book_id, unnest(list_distinct(authors)) AS name FROM book_list",
    "author_ids": """
        SELECT row_number() OVER (ORDER BY substr(md5(name), 1, 3), name) AS id, name
        FROM (SELECT DISTINCT name FROM names)""",
    "newest": """
        SELECT source_book_id, candidate_book_id, arg_max(label, command_id) AS label,
               max(created_at) AS created_at
        FROM commands GROUP BY ALL""",
    "feedback": "SELECT * FROM newest WHERE label <> 0",
    "rated": """
        SELECT source_book_id AS book_id, candidate_book_id AS similar_book_id, label
        FROM feedback""",
    "all_pairs": """
        SELECT s.id AS book_id, c.id AS similar_book_id,
               round(list_cosine_similarity(s.vec, c.vec), 9) AS score,
               s.file = c.file AS same_file, s.title = c.title AS same_title,
               list_has_any(s.authors, c.authors) AS same_author,
               c.title AS title, list_sort(c.authors) AS key_authors
        FROM item_authors s CROSS JOIN item_authors c""",
    "allowed": "SELECT * FROM all_pairs WHERE NOT same_file AND NOT same_title",
    "best": """
        SELECT * FROM allowed QUALIFY row_number() OVER (
            PARTITION BY book_id, title, key_authors ORDER BY score DESC, similar_book_id) = 1""",
    "topk": f"""
        SELECT book_id, similar_book_id, score,
               row_number() OVER (PARTITION BY book_id ORDER BY score DESC, similar_book_id) AS rank
        FROM best QUALIFY rank <= {K}""",
    "topk_bulk": f"""
        SELECT book_id, similar_book_id, score,
               row_number() OVER (PARTITION BY book_id ORDER BY score DESC, similar_book_id) AS rank
        FROM best QUALIFY rank <= {BULK}""",
    "cells": "SELECT row_number() OVER (ORDER BY id) - 1 AS cell, vec FROM items WHERE id % 25 = 0",
    "near_cells": """
        SELECT i.id, c.cell, row_number() OVER (PARTITION BY i.id
                   ORDER BY round(list_cosine_similarity(i.vec, c.vec), 9) DESC, c.cell) - 1 AS place
        FROM items i CROSS JOIN cells c""",
    "homes": "SELECT id, cell FROM near_cells WHERE place = 0",
    "visits": """
        SELECT id, cell, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS place
        FROM near_cells WHERE cell IN (SELECT cell FROM homes)""",
    "met": """
        SELECT a.*, v.place FROM allowed a JOIN homes h ON h.id = a.similar_book_id
        JOIN visits v ON v.id = a.book_id AND v.cell = h.cell WHERE NOT a.same_author""",
    "met_keys": """
        SELECT book_id, min(place) AS place FROM met GROUP BY book_id, title, key_authors""",
    "visited": f"""
        SELECT book_id, 3 * 2 ** greatest(0, ceil(log2((place + 1) / 3.0))) AS cells
        FROM met_keys QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY place) = {K}""",
    "top_edges": f"""
        SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, similar_book_id) AS rank
        FROM edges QUALIFY rank <= {K}""",
    "paragraphs": f"""
        SELECT doc_id, source, lang,
               list_filter(list_transform(string_split(text, chr(10)),
                                          lambda x: trim(x, '{WHITESPACE}')),
                           lambda x: x <> '') AS p
        FROM documents""",
    "sampled": """
        SELECT *, list_concat(list_concat(p[1:5],
            CASE WHEN len(p) > 10 THEN p[greatest(5, len(p) // 2 - 2) + 1
                                         : greatest(5, len(p) // 2 - 2) + 5] ELSE [] END),
            p[greatest(len(p) - 5, 0) + 1 : len(p)]) AS parts
        FROM paragraphs""",
    "markup": f"""
        SELECT doc_id, lang, '<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="{BOOK_NAMESPACE}">'
            || '<description><title-info><author><first-name>' || lang || '</first-name><last-name>'
            || source || '</last-name></author><book-title>Document ' || doc_id
            || '</book-title></title-info><document-info><id>d' || doc_id
            || '</id></document-info></description><body><section><p>'
            || replace(replace(replace(replace(regexp_replace(text,
                   '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g'),
                   '&', '&amp;'), '<', '&lt;'), chr(13), '&#13;'), chr(10), '</p><p>')
            || '</p></section></body></FictionBook>' AS content
        FROM documents""",
}


def _using(views: str, query: str) -> str:
    """The query after the views it names (in order of their definition)."""
    wanted = set()

    def need(names: list[str]) -> None:
        for name in names:
            if name not in wanted:
                wanted.add(name)
                need([v for v in VIEWS if re.search(rf"(FROM|JOIN) {v}\b", VIEWS[name])])

    need(views.split())
    parts = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in wanted)
    return f"WITH {parts} {query}" if parts else query


def _view(edges: str) -> str:
    link = f"'{LIBRARY_URL}/#/"
    return f"""
        SELECT e.book_id, e.rank, e.similar_book_id, b.book AS file,
               round(e.score * 100, 2) AS percent, b.title, array_to_string(b.authors, ', ') AS authors,
               {link}title?title=' || b.title AS title_url,
               array_to_string(list_transform(b.authors,
                   lambda a: {link}author?author=' || a), ' ') AS author_urls,
               coalesce(r.label, 0.0) AS rating
        FROM {edges} e LEFT JOIN book_list b ON b.id = e.similar_book_id
        LEFT JOIN rated r ON r.book_id = e.book_id AND r.similar_book_id = e.similar_book_id"""


def _prompt() -> str:
    pieces = JUDGE_PROMPT.split("%s")
    values = ["s.title", "s.author", "c.title", "c.author"]
    text = f"'{pieces[0]}'"
    for value, piece in zip(values, pieces[1:]):
        text += f" || {value} || '{piece}'"
    return text


_JUDGED = f"""
    SELECT e.book_id AS source_book_id, e.similar_book_id AS candidate_book_id, {_prompt()} AS prompt
    FROM top_edges e JOIN books s ON s.id = e.book_id JOIN books c ON c.id = e.similar_book_id"""

_LISTED = "SELECT book_id, similar_book_id, score, rank FROM topk"

_OVERFETCHED = f"""
    SELECT book_id, similar_book_id, score,
           row_number() OVER (PARTITION BY book_id ORDER BY score DESC, similar_book_id) AS rank
    FROM (SELECT * FROM (
              SELECT * FROM all_pairs QUALIFY row_number() OVER (
                  PARTITION BY book_id ORDER BY score DESC, similar_book_id) <= {overfetch(K, 1 << 40)})
          WHERE NOT same_file AND NOT same_title
          QUALIFY row_number() OVER (PARTITION BY book_id, title, key_authors
                                     ORDER BY score DESC, similar_book_id) = 1)
    QUALIFY rank <= {K}"""

_RATINGS = "SELECT source_book_id, candidate_book_id, label FROM feedback"

_RATED_EDGES = """
    FROM edges e LEFT JOIN rated r
    ON r.book_id = e.book_id AND r.similar_book_id = e.similar_book_id"""

_AFTER_DISLIKES = """
    SELECT * FROM edges e WHERE NOT EXISTS (
        SELECT 1 FROM commands c WHERE c.label < 0
        AND c.source_book_id = e.book_id AND c.candidate_book_id = e.similar_book_id)"""

# An edge counts as strong from this score on in the query that mixes stored and new lists.
_STRONG = "SELECT * FROM edges WHERE score > 0.9"

TWINS = {
    "catalogue_parse": _using("catalogue", "SELECT * FROM catalogue"),
    "incremental_new_books": _using(
        "catalogue with_vector",
        "SELECT archive, book FROM catalogue WHERE book NOT IN (SELECT book FROM with_vector)",
    ),
    "author_dim": _using("author_ids", "SELECT id, name FROM author_ids"),
    "author_bridge": _using(
        "author_ids",
        "SELECT n.book_id, a.id AS author_id FROM names n JOIN author_ids a ON a.name = n.name",
    ),
    "books_of_rated": _using(
        "books feedback",
        """
        SELECT id, book, archive, title, author FROM books
        WHERE id IN (SELECT source_book_id FROM feedback UNION SELECT candidate_book_id FROM feedback)""",
    ),
    "one_book_per_file": """
        SELECT min(l_orderkey) AS id, l_partkey || '.fb2' AS book FROM lineitem GROUP BY l_partkey""",
    "books_with_vectors": _using(
        "books vectors",
        """
        SELECT b.id, b.book, b.title, b.author, len(v.embedding) AS dimensions
        FROM books b JOIN vectors v ON v.book_id = b.id""",
    ),
    "vector_count": "SELECT count(*) AS n FROM embeddings",
    "book_upsert": _using(
        "catalogue with_vector",
        """
        SELECT w.id, c.book, c.archive, 'u' AS uid, c.title, c.author
        FROM catalogue c JOIN with_vector w ON w.book = c.book AND w.archive = c.archive
        UNION ALL
        SELECT w.id, w.book, w.archive, NULL, w.title, w.author FROM with_vector w
        WHERE NOT EXISTS (SELECT 1 FROM catalogue c WHERE c.book = w.book AND c.archive = w.archive)
        UNION ALL
        SELECT (SELECT max(id) FROM with_vector) + row_number() OVER (ORDER BY substr(md5(
                   '{"book":"' || book || '","archive":"' || archive || '"}'), 1, 3), book, archive),
               book, archive, 'u', title, author
        FROM catalogue c WHERE NOT EXISTS (
            SELECT 1 FROM with_vector w WHERE c.book = w.book AND c.archive = w.archive)""",
    ),
    "paragraph_sample": _using(
        "sampled",
        """
        SELECT doc_id, len(p) AS n_paragraphs, CASE WHEN len(p) = 0 THEN '' ELSE
               array_to_string(list_concat([source, lang], parts), chr(10) || chr(10)) END AS sample
        FROM sampled""",
    ),
    "fb2_extract": _using(
        "sampled",
        """
        SELECT doc_id, 'd' || doc_id AS uid, 'Document ' || doc_id AS title,
               lang || ' ' || source AS author, len(p) AS n_paragraphs,
               CASE WHEN len(p) = 0 THEN '' ELSE
               array_to_string(list_concat(['Document ' || doc_id, lang || ' ' || source], parts),
                               chr(10) || chr(10)) END AS sample
        FROM sampled""",
    ),
    "archive_listing": _using(
        "markup", "SELECT 'd' || doc_id || '.fb2' AS member, strlen(content) AS size FROM markup"
    ),
    "archive_members": _using(
        "markup", "SELECT 'd' || doc_id || '.fb2' AS member, strlen(content) AS size, md5(content) AS digest FROM markup"
    ),
    "stream_ingest": """
        SELECT 'd' || doc_id || '.fb2' AS book, 'd' || doc_id AS uid, 'Document ' || doc_id AS title,
               lang || ' ' || source AS author, lang || ' ' || source AS name, 256 AS dimensions
        FROM documents""",
    "stream_members": """
        SELECT 'd' || doc_id || '.fb2' AS book, 'd' || doc_id AS uid, 'Document ' || doc_id AS title,
               lang || ' ' || source AS author, lang || ' ' || source AS name, 256 AS dimensions
        FROM documents""",
    "vector_norm": _using(
        "vectors",
        """
        SELECT book_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]),
                                                      CAST(embedding AS DOUBLE[]))), 6) AS norm,
               CAST(1.0 AS DOUBLE) AS unit_norm
        FROM vectors""",
    ),
    "blob_round_trip": _using(
        "vectors",
        """
        SELECT book_id, 4 * len(embedding) AS n_bytes,
               round(CAST(embedding[1] AS DOUBLE), 6) AS first_value
        FROM vectors""",
    ),
    "cosine_pairs": _using(
        "edges items",
        """
        SELECT e.book_id, e.similar_book_id, round(list_cosine_similarity(
                   CAST(s.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS cosine
        FROM edges e JOIN vectors s ON s.book_id = e.book_id
        JOIN vectors c ON c.book_id = e.similar_book_id""",
    ),
    "topk_exact_raw": _using(
        "all_pairs",
        f"""
        SELECT book_id, similar_book_id, score,
               row_number() OVER (PARTITION BY book_id ORDER BY score DESC, similar_book_id) AS rank
        FROM all_pairs WHERE NOT same_file QUALIFY rank <= {K}""",
    ),
    "topk_dedup": _using("topk", _LISTED),
    "topk_first_title": _using(
        "allowed",
        f"""
        SELECT book_id, similar_book_id, score,
               row_number() OVER (PARTITION BY book_id ORDER BY score DESC, similar_book_id) AS rank
        FROM (SELECT * FROM allowed QUALIFY row_number() OVER (
                  PARTITION BY book_id, title ORDER BY similar_book_id) = 1)
        QUALIFY rank <= {K}""",
    ),
    "topk_other_authors": _using(
        "allowed",
        f"""
        SELECT book_id, similar_book_id, score,
               row_number() OVER (PARTITION BY book_id ORDER BY score DESC, similar_book_id) AS rank
        FROM (SELECT * FROM allowed WHERE NOT same_author QUALIFY row_number() OVER (
                  PARTITION BY book_id, title, key_authors ORDER BY score DESC, similar_book_id) = 1)
        QUALIFY rank <= {K}""",
    ),
    "topk_overfetch": _using("all_pairs", _OVERFETCHED),
    "ann_full_probe": _using("all_pairs", _OVERFETCHED),
    "similar_of_most_rated": _using(
        "topk commands",
        _LISTED
        + """ WHERE book_id = (SELECT source_book_id FROM commands GROUP BY 1
              ORDER BY count(*) DESC, source_book_id LIMIT 1)""",
    ),
    "cached_or_compute": _using(
        "topk commands edges",
        f"""
        SELECT book_id, similar_book_id, score, rank FROM (
            SELECT book_id, similar_book_id, score,
                   row_number() OVER (PARTITION BY book_id ORDER BY score DESC, similar_book_id) AS rank
            FROM ({_STRONG}) WHERE book_id IN (SELECT source_book_id FROM commands)
        ) WHERE rank <= {K}
        UNION ALL
        {_LISTED} WHERE book_id IN (SELECT source_book_id FROM commands)
        AND book_id NOT IN (SELECT book_id FROM ({_STRONG}))""",
    ),
    "topk_cell_bounds": _using(
        "all_pairs",
        f"""
        SELECT book_id, similar_book_id, score,
               row_number() OVER (PARTITION BY book_id ORDER BY score DESC, similar_book_id) AS rank
        FROM all_pairs WHERE NOT same_file QUALIFY rank <= {K}""",
    ),
    "ann_given_cells": _using(
        "met visited",
        f"""
        SELECT book_id, similar_book_id, score,
               row_number() OVER (PARTITION BY book_id ORDER BY score DESC, similar_book_id) AS rank
        FROM (SELECT m.* FROM met m LEFT JOIN visited v ON v.book_id = m.book_id
              WHERE v.cells IS NULL OR m.place < v.cells
              QUALIFY row_number() OVER (PARTITION BY m.book_id, title, key_authors
                                         ORDER BY score DESC, similar_book_id) = 1)
        QUALIFY rank <= {K}""",
    ),
    "cached_or_compute_all": _using(
        "topk commands edges",
        f"""
        SELECT book_id, similar_book_id, score, rank FROM (
            SELECT book_id, similar_book_id, score,
                   row_number() OVER (PARTITION BY book_id ORDER BY score DESC, similar_book_id) AS rank
            FROM edges WHERE book_id IN (SELECT source_book_id FROM commands)
        ) WHERE rank <= {K}
        UNION ALL
        {_LISTED} WHERE book_id IN (SELECT source_book_id FROM commands)
        AND book_id NOT IN (SELECT book_id FROM edges)""",
    ),
    "blob_components": """
        SELECT vec_id AS book_id, unnest(range(len(embedding)))::INT AS place, unnest(embedding) AS value
        FROM embeddings""",
    "unit_blobs": _using(
        "unit_vectors",
        """
        SELECT book_id, n_bytes, place, round(CAST(x / norm AS FLOAT)::DOUBLE, 5) AS value FROM (
            SELECT book_id, 4 * len(vec)::INT AS n_bytes, unnest(range(len(vec)))::INT AS place,
                   unnest(vec) AS x, sqrt(list_inner_product(vec, vec)) AS norm
            FROM unit_vectors)""",
    ),
    "edges_of_deleted": _using("edges", "SELECT * FROM edges WHERE book_id % 10 <> 0 OR book_id NOT IN (SELECT p_partkey FROM part)"),
    "edges_appended": _using(
        "edges",
        "SELECT * FROM edges UNION ALL SELECT similar_book_id AS book_id, book_id AS similar_book_id, score FROM edges",
    ),
    "embedding_upsert": """
        SELECT vec_id AS book_id, unnest(range(len(embedding)))::INT AS place,
               CASE WHEN vec_id % 3 = 0 THEN -unnest(embedding) ELSE unnest(embedding) END AS value
        FROM embeddings""",
    "author_bridge_again": _using(
        "book_list",
        """
        SELECT id AS book_id, unnest(list_distinct(CASE WHEN id % 7 = 0 THEN ['Someone', authors[1]] ELSE authors END)) AS name
        FROM book_list""",
    ),
    "requests_not_served": _using(
        "books edges vectors",
        """
        SELECT CASE WHEN b.id IS NULL THEN 'unknown' ELSE 'no vector' END AS what, file_name
        FROM (SELECT DISTINCT c_custkey * 3 || '.fb2' AS file_name FROM customer) LEFT JOIN books b ON b.book = file_name
        WHERE b.id IS NULL OR (b.id NOT IN (SELECT book_id FROM edges WHERE book_id % 2 = 0)
                               AND b.id NOT IN (SELECT book_id FROM vectors))""",
    ),
    "book_of_file": _using("books", "SELECT id, book, archive, title, author FROM books WHERE book = '7.fb2'"),
    "vector_of_book": """
        SELECT vec_id AS book_id, unnest(range(len(embedding)))::INT AS place, unnest(embedding) AS value
        FROM embeddings WHERE vec_id = 7""",
    "feedback_of_book": _using("feedback", "SELECT candidate_book_id, label FROM feedback WHERE source_book_id = 7"),
    "books_with_edges": _using(
        "books edges", "SELECT id AS book_id FROM books WHERE id IN (SELECT book_id FROM edges WHERE book_id % 2 = 0)"
    ),
    "file_names": "SELECT DISTINCT l_partkey || '.fb2' AS book FROM lineitem",
    "named_books": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'Known ' || doc_id ELSE 'Document ' || doc_id END AS title,
               CASE WHEN doc_id % 3 = 2 THEN 'A; B' ELSE lang || ' ' || source END AS author
        FROM documents""",
    "bulk_ranked_view": _using("topk_bulk book_list rated", _view("topk_bulk")),
    "edges_enriched": _using("top_edges book_list rated", _view("top_edges")),
    "edge_export": _using(
        "top_edges books",
        f"""
        SELECT e.book_id, e.rank, printf('%6.2f', e.score * 100) AS percent, b.book AS file, b.title,
               '{LIBRARY_URL}/#/extended?page=1&limit=20&ex_file=' || e.similar_book_id AS url
        FROM top_edges e LEFT JOIN books b ON b.id = e.similar_book_id""",
    ),
    "edge_texts": _using(
        "topk",
        """
        SELECT book_id, similar_book_id,
               printf('%.3f', score) || ' — ' || book_id || ' → ' || similar_book_id AS shown
        FROM topk""",
    ),
    "edge_lists": _using(
        "top_edges",
        """
        SELECT book_id, string_agg(CAST(similar_book_id AS VARCHAR), ',' ORDER BY rank) AS similar_ids
        FROM top_edges GROUP BY book_id""",
    ),
    "edge_replace": _using(
        "topk edges",
        """
        SELECT book_id, similar_book_id, score FROM topk
        UNION ALL SELECT * FROM edges WHERE book_id NOT IN (SELECT book_id FROM topk)""",
    ),
    "touched_ids": _using(
        "edges", "SELECT book_id AS id FROM edges UNION SELECT similar_book_id FROM edges"
    ),
    "edges_after_dislikes": _using("edges commands", _AFTER_DISLIKES),
    "edges_not_disliked": _using(
        "edges rated",
        f"SELECT e.* {_RATED_EDGES} WHERE r.label IS NULL OR r.label >= 0",
    ),
    "rating_attach": _using(
        "edges rated", f"SELECT e.*, coalesce(r.label, 0.0) AS rating {_RATED_EDGES}"
    ),
    "boosted_score": _using(
        "edges rated", f"SELECT e.*, round(coalesce(r.label, 0.0) * 0.4, 6) AS boost {_RATED_EDGES}"
    ),
    "feedback_current": _using(
        "feedback",
        "SELECT source_book_id, candidate_book_id, label, epoch_us(created_at) AS at FROM feedback",
    ),
    "feedback_ids": _using(
        "newest",
        "SELECT count(*) AS n, 1 AS lowest, count(*) AS highest, count(*) AS n_distinct FROM newest",
    ),
    "feedback_mean": _using(
        "commands",
        """
        SELECT source_book_id, candidate_book_id, round(avg(label), 6) AS label
        FROM commands GROUP BY ALL""",
    ),
    "feedback_exchange": _using("feedback", _RATINGS),
    "unresolved_commands": _using(
        "commands catalogue",
        """
        SELECT source_file_name, count(*) AS n FROM commands
        WHERE source_file_name NOT IN (SELECT book FROM catalogue)
           OR candidate_file_name NOT IN (SELECT book FROM catalogue)
        GROUP BY 1""",
    ),
    "stream_feedback": _using("feedback", _RATINGS),
    "stream_edges": _using("edges commands", _AFTER_DISLIKES),
    "stream_state_feedback": _using("feedback", _RATINGS),
    "stream_state_edges": _using("edges commands", _AFTER_DISLIKES),
    "feedback_replaced": _using("feedback", f"{_RATINGS} WHERE source_book_id % 2 = 0"),
    "feedback_judged": _using(
        "top_edges books feedback",
        f"""
        SELECT source_book_id, candidate_book_id,
               round(least(100, length(prompt) - 250) / 100.0, 6) AS label
        FROM ({_JUDGED})
        UNION ALL
        SELECT source_book_id, candidate_book_id, round(label, 6) AS label FROM feedback f
        WHERE NOT EXISTS (SELECT 1 FROM ({_JUDGED}) j WHERE j.source_book_id = f.source_book_id
                          AND j.candidate_book_id = f.candidate_book_id)""",
    ),
    "star_map": """
        SELECT l_orderkey, l_linenumber, round(l_linenumber * 0.2, 6) AS label,
               CAST(floor(l_discount * 10 / 0.2 + 0.5) AS INTEGER) AS stars
        FROM lineitem""",
    "judge_labels": """
        SELECT event_id, CASE WHEN regexp_full_match(answer, '[+-]?[0-9]+')
                              THEN round(CAST(answer AS BIGINT) / 100.0, 6) END AS label
        FROM (SELECT event_id, CASE event_type WHEN 'view' THEN CAST(value AS VARCHAR)
                  WHEN 'error' THEN 'error' WHEN 'signup' THEN ''
                  ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS answer FROM events)""",
    "judge_prompts": _using("top_edges books", _JUDGED),
    "judged_edges": _using(
        "top_edges books",
        f"""
        SELECT source_book_id, candidate_book_id,
               round(least(100, length(prompt) - 250) / 100.0, 6) AS label
        FROM ({_JUDGED})""",
    ),
    "train_set_rerank": _using(
        "feedback vectors",
        """
        SELECT f.source_book_id, f.candidate_book_id, round(list_cosine_similarity(
                   CAST(s.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS similarity,
               f.label, CASE WHEN f.label < 0 THEN 1.2 ELSE 1.0 END AS weight
        FROM feedback f JOIN vectors s ON s.book_id = f.source_book_id
        JOIN vectors c ON c.book_id = f.candidate_book_id""",
    ),
    "train_pairs": _using(
        "feedback sampled",
        """
        SELECT f.source_book_id, f.candidate_book_id, s.sample AS source_text,
               c.sample AS candidate_text, round((f.label + 1) / 2, 6) AS score
        FROM feedback f
        JOIN (SELECT doc_id, array_to_string(parts, chr(10) || chr(10)) AS sample FROM sampled) s
            ON s.doc_id = f.source_book_id
        JOIN (SELECT doc_id, array_to_string(parts, chr(10) || chr(10)) AS sample FROM sampled) c
            ON c.doc_id = f.candidate_book_id""",
    ),
    "edge_score_report": _using(
        "rated edges unit_vectors",
        """
        SELECT r.book_id, r.similar_book_id, r.label, coalesce(e.score, 0.0) AS stored_score,
               round(list_inner_product(s.vec, c.vec), 6) AS score_now
        FROM rated r JOIN unit_vectors s ON s.book_id = r.book_id
        JOIN unit_vectors c ON c.book_id = r.similar_book_id
        LEFT JOIN edges e ON e.book_id = r.book_id AND e.similar_book_id = r.similar_book_id""",
    ),
}
TWINS["edge_replace_stored"] = TWINS["edge_replace"]
TWINS["learning_job"] = TWINS["edge_score_report"]
