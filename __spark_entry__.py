"""

Queries run over whole tables. ``oracle_sql`` has a twin for every query whose result SQL
can state; approximate search, learnt models and web-page recovery have none.
"""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kindred.functions import labels, text, vectors  # noqa: E402
from kindred.functions.display import edge_text  # noqa: E402
from kindred.operators import edges as edge_ops  # noqa: E402
from kindred.operators import feedback as feedback_ops  # noqa: E402
from kindred.operators import judge, lookups, reports, rerank  # noqa: E402
from kindred.operators.cells import CellIndex  # noqa: E402
from kindred.operators.descent import neighbour_graph  # noqa: E402
from kindred.operators.encode import encode_by_words  # noqa: E402
from kindred.operators.extract import describe, read_markup, sample_plain  # noqa: E402
from kindred.operators.graph_index import GraphIndex, graph_top_k  # noqa: E402
from kindred.operators.kernel import Rules  # noqa: E402
from kindred.operators.rounds import bounded_top_k, filled_top_k, probes_for  # noqa: E402
from kindred.operators.similarity import (  # noqa: E402
    exact_top_k,
    library_items,
    top_k_overfetched,
)
from kindred.plans import learn, stand_ins  # noqa: E402
from kindred.plans.similar import ANN, EXACT, bulk_edges, search, similar_books  # noqa: E402
from kindred.schemas import AUTHORS, BOOK_AUTHORS, EMBEDDINGS, FEEDBACK, FEEDBACK_JSON, SIMILAR  # noqa: E402
from kindred.session import ship, stage, work_path  # noqa: E402
from kindred.sources import feedback_json, tables  # noqa: E402
from kindred.sources.archive_format import archives_under  # noqa: E402
from kindred.sources.archives import list_members  # noqa: E402
from kindred.sources.catalogue import (  # noqa: E402
    catalogue_books,
    eligible,
    parse_lines,
    unseen,
)
from kindred.sources.store import Store, Table  # noqa: E402
from kindred.streaming import feedback as feedback_stream  # noqa: E402
from kindred.streaming import ingest as ingest_stream  # noqa: E402
from kindred.streaming import ratings as rating_stream  # noqa: E402

try:  # the operators for training text can be left out
    import corpus_pipeline
    from kindred.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "kindred.llm"):
        raise
    corpus_pipeline = llm_queries = None

K = 10
# Fixed value: edges that the bulk job keeps of a book.
BULK = 100
URL = stand_ins.LIBRARY_URL


# --------------------------------------------------------------------------- inputs


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return stand_ins.spread(
        library_items(stand_ins.books(spark, sf), stand_ins.vectors(spark, sf))
    )


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    known, _ = feedback_ops.resolve(stand_ins.commands(spark, sf), stand_ins.books(spark, sf))
    return known


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    """The feedback table after all commands."""
    empty = spark.createDataFrame([], FEEDBACK)
    table = feedback_ops.apply_to_feedback(empty, _commands(spark, sf))
    return feedback_ops.stored(table)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = stand_ins.table(spark, sf, "documents").select("doc_id", "text")
    return sample_plain(stand_ins.spread(docs)).select(F.col("doc_id").alias("book_id"), "sample")


# ------------------------------------------------------------------------ catalogue


def catalogue_parse(spark: SparkSession, sf: str) -> DataFrame:
    records = parse_lines(stand_ins.catalogue_lines(spark, sf))
    return catalogue_books(eligible(records)).select("archive", "book", "title", "author")


def incremental_new_books(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue books that are not among the books with a vector."""
    found = catalogue_books(eligible(parse_lines(stand_ins.catalogue_lines(spark, sf))))
    books, vecs = stand_ins.books(spark, sf), stand_ins.vectors(spark, sf)
    done = books.join(vecs.select(F.col("book_id").alias("id")), "id", "left_semi")
    return unseen(found, done).select("archive", "book")


def _author_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    books = stand_ins.books(spark, sf)
    batch = books.select(
        F.col("id").alias("book_id"), text.author_list(F.col("author")).alias("authors")
    )
    none = spark.createDataFrame([], AUTHORS), spark.createDataFrame([], BOOK_AUTHORS)
    return tables.save_authors(*none, batch)


def author_dim(spark: SparkSession, sf: str) -> DataFrame:
    return _author_tables(spark, sf)[0]


def author_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return _author_tables(spark, sf)[1]


def books_of_rated(spark: SparkSession, sf: str) -> DataFrame:
    """Books that occur in any rating."""
    ids = edge_ops.touched_ids(_feedback(spark, sf), "source_book_id", "candidate_book_id")
    return lookups.books_by_ids(stand_ins.books(spark, sf), ids)


def one_book_per_file(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as copies of their part's file: one row per file, the lowest id."""
    rows = stand_ins.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.concat(F.col("l_partkey").cast("string"), F.lit(".fb2")).alias("book"),
        F.lit("a.zip").alias("archive"),
        F.lit("t").alias("title"),
        F.lit(None).cast("string").alias("author"),
    )
    return lookups.one_per_file(rows).select("id", "book")


def books_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = lookups.books_with_vectors(stand_ins.books(spark, sf), stand_ins.vectors(spark, sf))
    return rows.select("id", "book", "title", "author", F.size("embedding").alias("dimensions"))


def vector_count(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.count_vectors(stand_ins.vectors(spark, sf))


def book_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Save the catalogue's books over the books with a vector: known ones keep their id."""
    books, vecs = stand_ins.books(spark, sf), stand_ins.vectors(spark, sf)
    have = books.join(vecs.select(F.col("book_id").alias("id")), "id", "left_semi")
    found = catalogue_books(eligible(parse_lines(stand_ins.catalogue_lines(spark, sf))))
    batch = found.select(
        "book", "archive", F.lit("u").alias("uid"), "title", "author", F.current_timestamp().alias("added_at")
    )
    return tables.save_books(have, batch).select("id", "book", "archive", "uid", "title", "author")


# ----------------------------------------------------------------------- extraction


def paragraph_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = stand_ins.table(spark, sf, "documents").select(
        "doc_id",
        "text",
        F.col("source").alias("title"),
        F.array("lang").alias("authors"),
    )
    return sample_plain(stand_ins.spread(docs)).select("doc_id", "n_paragraphs", "sample")


def fb2_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as book markup, read back: id, title, authors, text sample."""
    books = stand_ins.document_books(spark, sf).select("doc_id", "content")
    read = describe(read_markup(books))
    return read.select(
        "doc_id",
        "uid",
        "title",
        F.array_join("authors", "; ").alias("author"),
        "n_paragraphs",
        "sample",
    )


def page_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of web pages whose markup is often broken."""
    pages = stand_ins.table(spark, sf, "pages").select("page_id", "html")
    read = read_markup(stand_ins.spread(pages), "html", namespace=None)
    return describe(read).select("page_id", "n_paragraphs", "sample", "error")


def _archives(spark: SparkSession, sf: str) -> str:
    """The documents as ZIP archives of book markup in a fresh shared folder."""
    folder = work_path(spark, "archives")
    written = stand_ins.write_archives(stand_ins.document_books(spark, sf), folder)
    written.write.format("noop").mode("overwrite").save()
    return folder


def archive_listing(spark: SparkSession, sf: str) -> DataFrame:
    found = list_members(spark, _archives(spark, sf))
    return found.where("error IS NULL").select("member", "size")


def archive_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of archives and their bytes, read as a format of Spark."""
    found = archives_under(spark, _archives(spark, sf))
    return found.where("error IS NULL").select("member", "size", F.md5("content").alias("digest"))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Archives through the ingestion stream into the library tables, joined for comparison."""
    folder = _archives(spark, sf)
    return _ingested(spark, ingest_stream.archive_stream(spark, folder), ingest_stream.books_of_archives, folder)


def stream_members(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the archives as a stream of their members."""
    folder = _archives(spark, sf)
    members = ingest_stream.member_stream(spark, folder, work_path(spark, "arrivals"))
    return _ingested(spark, members, ingest_stream.books_of_members, folder)


def _ingested(spark: SparkSession, stream: DataFrame, to_books: Callable, folder: str) -> DataFrame:
    store = ingest_stream.LibraryStore(spark, work_path(spark, "library"))
    ingest_stream.start(
        stream,
        to_books,
        folder,
        store,
        lambda texts: encode_by_words(texts, weigh=False),
        work_path(spark, "ingest-state"),
        available_now=True,
    ).awaitTermination()
    library = store.read()
    names = library.book_authors.join(
        library.authors.withColumnRenamed("id", "author_id"), "author_id"
    ).select(F.col("book_id").alias("id"), "name")
    with_vector = library.embeddings.select(
        F.col("book_id").alias("id"), F.size("embedding").alias("dimensions")
    )
    return (
        library.books.join(names, "id")
        .join(with_vector, "id")
        .select("book", "uid", "title", "author", "name", "dimensions")
    )


# ------------------------------------------------------------------------- vectors


def vector_norm(spark: SparkSession, sf: str) -> DataFrame:
    vecs = stand_ins.vectors(spark, sf).where(vectors.has_direction("embedding"))
    return vecs.select(
        "book_id",
        F.round(vectors.l2_norm("embedding"), 6).alias("norm"),
        F.round(vectors.l2_norm(vectors.normalise("embedding")), 5).alias("unit_norm"),
    )


def blob_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to bytes and back."""
    blobs = stand_ins.vectors(spark, sf).select(
        "book_id", vectors.encode_blob("embedding").alias("blob")
    )
    back = blobs.select("book_id", F.length("blob").alias("n_bytes"), vectors.decode_blob("blob").alias("v"))
    first = F.element_at("v", 1).cast("double")
    return back.select("book_id", "n_bytes", F.round(first, 6).alias("first_value"))


def blob_components(spark: SparkSession, sf: str) -> DataFrame:
    """Every component of the vectors after the way to bytes and back."""
    blobs = stand_ins.vectors(spark, sf).select("book_id", vectors.encode_blob("embedding").alias("blob"))
    return blobs.select("book_id", F.posexplode(vectors.decode_blob("blob")).alias("place", "value"))


def unit_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as they are stored and read back: normalised on both ways."""
    stored = stand_ins.vectors(spark, sf).select("book_id", vectors.vector_to_store("embedding").alias("blob"))
    read = stored.select("book_id", F.length("blob").alias("n_bytes"), F.posexplode(vectors.stored_vector("blob")).alias("place", "value"))
    return read.withColumn("value", F.round(F.col("value").cast("double"), 5))


def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of the vectors at both ends of every edge."""
    vecs = stand_ins.vectors(spark, sf)
    source = vecs.select("book_id", F.col("embedding").alias("s"))
    other = vecs.select(F.col("book_id").alias("similar_book_id"), F.col("embedding").alias("c"))
    pairs = stand_ins.edges(spark, sf).select("book_id", "similar_book_id")
    joined = pairs.join(source, "book_id").join(other, "similar_book_id")
    return joined.select(
        "book_id", "similar_book_id", F.round(vectors.cosine("s", "c"), 9).alias("cosine")
    )


# -------------------------------------------------------------------------- search


def topk_exact_raw(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    return exact_top_k(items, items, K, Rules(same_title=False, dedup="none"))


def topk_dedup(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    return exact_top_k(items, items, K)


def topk_first_title(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    return exact_top_k(items, items, K, Rules(dedup="first"))


def topk_other_authors(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    return exact_top_k(items, items, K, Rules(same_author=True))


def topk_overfetch(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    return top_k_overfetched(items, items, K)


def ann_full_probe(spark: SparkSession, sf: str) -> DataFrame:
    """The index search with every cell probed: must equal the exact one."""
    items = _items(spark, sf)
    index = CellIndex.build(items, cells=16)
    found = search(ANN, items, items, K, index=index, nprobe=index.cells)
    return found.select("book_id", "similar_book_id", "score", "rank")


def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The index search with as many probes as a measured recall asks for."""
    items = _items(spark, sf)
    index = CellIndex.build(items)
    return filled_top_k(items, index, K, nprobe=probes_for(index, K)).lists


def ann_vs_exact(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    return reports.overlap(exact_top_k(items, items, K), ann_topk(spark, sf))


def ann_given_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Three probes of cells around given vectors; short lists go on to more cells."""
    items = stage(_items(spark, sf), "items")
    index = CellIndex.build(items, around=items.where("id % 25 = 0"))
    return filled_top_k(items, index, K, Rules(same_author=True), nprobe=3).lists


def topk_cell_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Exact lists from an index, each source visiting only cells that can matter."""
    items = _items(spark, sf)
    return bounded_top_k(items, CellIndex.build(items), K, Rules(same_title=False, dedup="none")).lists


def cell_visits(spark: SparkSession, sf: str) -> DataFrame:
    """What the exact search over cells looked at: vectors as given, and documents by their words."""
    found = []
    for name, items in (("embeddings", _items(spark, sf)), ("documents", _document_items(spark, sf))):
        visits = bounded_top_k(items, CellIndex.build(items), K, Rules(same_title=False, dedup="none"))
        found.append((name, visits.rounds, visits.compared, visits.possible, visits.skipped))
    return spark.createDataFrame(found, "vectors string, rounds int, compared long, possible long, skipped double")


def similar_of_most_rated(spark: SparkSession, sf: str) -> DataFrame:
    """The one-book query, for the book readers rated most often."""
    counts = _commands(spark, sf).groupBy("source_book_id").count()
    most = counts.orderBy(F.desc("count"), "source_book_id").limit(1)
    items = _items(spark, sf)
    source = items.join(most.select(F.col("source_book_id").alias("id")), "id", "left_semi")
    return exact_top_k(source, items, K, few=True)


def cached_or_compute(spark: SparkSession, sf: str) -> DataFrame:
    """Similar books for every rated book: stored strong edges, else a search."""
    requests = stand_ins.commands(spark, sf).select(F.col("source_file_name").alias("file_name"))
    answer = similar_books(
        requests,
        stand_ins.books(spark, sf),
        stand_ins.vectors(spark, sf),
        stand_ins.edges(spark, sf).where("score > 0.9"),
        limit=K,
    )
    return answer.lists


def cached_or_compute_all(spark: SparkSession, sf: str) -> DataFrame:
    """Similar books for every rated book: all stored edges, else a search."""
    requests = stand_ins.commands(spark, sf).select(F.col("source_file_name").alias("file_name"))
    books, vecs, edges = stand_ins.books(spark, sf), stand_ins.vectors(spark, sf), stand_ins.edges(spark, sf)
    return similar_books(requests, books, vecs, edges, limit=K).lists


def bulk_ranked_view(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: edges of all books, shown with titles, authors, links and ratings."""
    books = stand_ins.books(spark, sf)
    edges = bulk_edges(books, stand_ins.vectors(spark, sf), limit=BULK, mode=EXACT)
    view = edge_ops.ranked_view(edges, books, _feedback(spark, sf), BULK, URL)
    return _flat_view(view)


def bulk_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of all books from a graph index: the bulk job as it runs by default."""
    return bulk_edges(stand_ins.books(spark, sf), stand_ins.vectors(spark, sf), limit=BULK)


def neighbour_graph_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbour graph by descent against the exact lists: rows of each, and the share found."""
    items = _items(spark, sf)
    exact = exact_top_k(items, items, BULK, Rules(same_title=False, dedup="none"))
    lists = neighbour_graph(items, BULK).lists
    return reports.overlap(exact, lists.select(F.col("id").alias("book_id"), F.col("nbr").alias("similar_book_id")))


def graph_topk(spark: SparkSession, sf: str) -> DataFrame:
    items = stage(_items(spark, sf), "items")
    return graph_top_k(items, GraphIndex.build(items), K).lists


def graph_vs_exact(spark: SparkSession, sf: str) -> DataFrame:
    items = stage(_items(spark, sf), "items")
    return reports.overlap(exact_top_k(items, items, K), graph_top_k(items, GraphIndex.build(items), K).lists)


def graph_insert(spark: SparkSession, sf: str) -> DataFrame:
    """The graph index of half of the books, grown by the others, against the exact lists."""
    items = stage(_items(spark, sf), "items")
    index = GraphIndex.build(items.where("id % 2 = 0")).insert(items.where("id % 2 = 1"))
    return reports.overlap(exact_top_k(items, items, K), graph_top_k(items, index, K).lists)


def documents_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Documents end to end: sample, encode, similar documents."""
    items = _document_items(spark, sf)
    return exact_top_k(items, items, K, Rules(dedup="none"))


def _document_items(spark: SparkSession, sf: str) -> DataFrame:
    docs = stand_ins.table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    sampled = sample_plain(stand_ins.spread(docs))
    # As in a library, vectors are stored once and searched from there.
    encoded = stage(encode_by_words(sampled).select("doc_id", "lang", "embedding"), "encoded")
    return encoded.select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".fb2")).alias("file"),
        F.lit(None).cast("string").alias("title"),
        F.array("lang").alias("authors"),
        F.col("embedding").alias("vec"),
    )


# --------------------------------------------------------------------------- edges


def _flat_view(view: DataFrame) -> DataFrame:
    return view.withColumn("author_urls", F.array_join("author_urls", " "))


def edges_enriched(spark: SparkSession, sf: str) -> DataFrame:
    view = edge_ops.ranked_view(
        stand_ins.edges(spark, sf), stand_ins.books(spark, sf), _feedback(spark, sf), K, URL
    )
    return _flat_view(view)


def edge_export(spark: SparkSession, sf: str) -> DataFrame:
    books, edges = stand_ins.books(spark, sf), stand_ins.edges(spark, sf)
    return edge_ops.export_rows(edge_ops.top_edges(edges, K).drop("rank"), books, URL)


def edge_texts(spark: SparkSession, sf: str) -> DataFrame:
    shown = edge_text(F.col("score"), F.col("book_id"), F.col("similar_book_id"))
    return topk_dedup(spark, sf).select("book_id", "similar_book_id", shown.alias("shown"))


def edge_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = edge_ops.edge_lists(stand_ins.edges(spark, sf), K)
    ids = F.transform("edges", lambda e: e["similar_book_id"].cast("string"))
    return lists.select("book_id", F.array_join(ids, ",").alias("similar_ids"))


def edge_replace(spark: SparkSession, sf: str) -> DataFrame:
    """New edges of every book with a vector replace its old ones; other books keep theirs."""
    items = _items(spark, sf)
    # Both its rows and its books are asked for: the search must not run twice.
    new = stage(exact_top_k(items, items, K), "new-edges")
    return tables.replace_groups(stand_ins.edges(spark, sf), new, "book_id")


def _edge_store(spark: SparkSession, sf: str) -> Store:
    store = Store(spark, work_path(spark, "edges"), {"similar": Table(SIMILAR, ("book_id",))})
    store.commit(replaced={"similar": stand_ins.edges(spark, sf)})
    return store


def edge_replace_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same on disk: a batch of the stored table adds its own files and rewrites none."""
    store, items = _edge_store(spark, sf), _items(spark, sf)
    store.commit({"similar": exact_top_k(items, items, K)})
    return store.read("similar")


def edges_of_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """Stored edges after those of every tenth book were deleted, and the table folded."""
    store = _edge_store(spark, sf)
    gone = stand_ins.books(spark, sf).where("id % 10 = 0").select(F.col("id").alias("book_id"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in SIMILAR.fields[1:]]
    store.commit(removed={"similar": gone.select("book_id", *nothing)})
    store.compact("similar", most=1)
    return store.read("similar")


def edges_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of new pairs beside those there are."""
    edges = stand_ins.edges(spark, sf)
    back = edges.select(F.col("similar_book_id").alias("book_id"), F.col("book_id").alias("similar_book_id"), "score")
    return tables.append(edges, back)


def embedding_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Stored vectors after a second batch: every third turned round, and new ones."""
    vecs = stand_ins.vectors(spark, sf)
    store = Store(spark, work_path(spark, "vectors"), {"embeddings": Table(EMBEDDINGS, ("book_id",))})
    store.commit({"embeddings": vecs.where("book_id % 5 <> 1")})
    again = vecs.where("book_id % 3 = 0 OR book_id % 5 = 1")
    turned = F.transform("embedding", lambda x: -x)
    store.commit({"embeddings": tables.save_embeddings(again, again.where("book_id % 3 = 0").withColumn("embedding", turned))})
    return store.read("embeddings").select("book_id", F.posexplode("embedding").alias("place", "value"))


def author_bridge_again(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all books after half of them, and then all with other names for some, were saved."""
    books = stand_ins.books(spark, sf)
    named = books.select(F.col("id").alias("book_id"), text.author_list(F.col("author")).alias("authors"))
    changed = F.when(F.col("book_id") % 7 == 0, F.array(F.lit("Someone"), F.element_at("authors", 1))).otherwise(F.col("authors"))
    none = spark.createDataFrame([], AUTHORS), spark.createDataFrame([], BOOK_AUTHORS)
    half = tables.save_authors(*none, named.where("book_id % 2 = 0"))
    authors, bridge = tables.save_authors(*half, named.withColumn("authors", changed))
    return bridge.join(authors.withColumnRenamed("id", "author_id"), "author_id").select("book_id", "name")


def requests_not_served(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for the books of all customers: unknown files, and books that have neither edges nor a vector."""
    customers = stand_ins.table(spark, sf, "customer")
    requests = customers.select(F.concat((F.col("c_custkey") * 3).cast("string"), F.lit(".fb2")).alias("file_name"))
    books, vecs, edges = stand_ins.books(spark, sf), stand_ins.vectors(spark, sf), stand_ins.edges(spark, sf)
    answer = similar_books(requests, books, vecs, edges.where("book_id % 2 = 0"), limit=K)
    unknown = answer.unknown.select(F.lit("unknown").alias("what"), "file_name")
    bare = answer.without_vector.join(books.withColumnRenamed("id", "book_id"), "book_id")
    return unknown.unionByName(bare.select(F.lit("no vector").alias("what"), F.col("book").alias("file_name")))


def book_of_file(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.book_by_file(stand_ins.books(spark, sf), "7.fb2")


def vector_of_book(spark: SparkSession, sf: str) -> DataFrame:
    found = lookups.vector_of(stand_ins.vectors(spark, sf), 7)
    return found.select("book_id", F.posexplode("embedding").alias("place", "value"))


def feedback_of_book(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.feedback_of(_feedback(spark, sf), 7).select("candidate_book_id", "label")


def books_with_edges(spark: SparkSession, sf: str) -> DataFrame:
    requests = stand_ins.books(spark, sf).select(F.col("id").alias("book_id"))
    return edge_ops.with_edges(requests, stand_ins.edges(spark, sf).where("book_id % 2 = 0"))


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the files that line items are copies of."""
    rows = stand_ins.table(spark, sf, "lineitem")
    return lookups.file_names(rows.select(F.concat(F.col("l_partkey").cast("string"), F.lit(".fb2")).alias("book")))


def named_books(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and authors of documents: the catalogue's where it has them, else those of the document."""
    read = describe(read_markup(stand_ins.document_books(spark, sf).select("doc_id", "content")))
    odd = F.col("doc_id") % 3
    known = F.when(odd == 0, F.lit("")).when(odd == 1, F.concat(F.lit("Known "), F.col("doc_id").cast("string")))
    names = F.when(odd == 2, F.array(F.lit("A"), F.lit("B"))).when(odd == 1, F.array().cast("array<string>"))
    both = text.fallback_list(names, F.col("authors"))
    return read.select("doc_id", text.fallback(known, F.col("title")).alias("title"), F.array_join(both, "; ").alias("author"))


def touched_ids(spark: SparkSession, sf: str) -> DataFrame:
    return edge_ops.touched_ids(stand_ins.edges(spark, sf), "book_id", "similar_book_id")


def edges_after_dislikes(spark: SparkSession, sf: str) -> DataFrame:
    return feedback_ops.apply_to_edges(stand_ins.edges(spark, sf), _commands(spark, sf))


def edges_not_disliked(spark: SparkSession, sf: str) -> DataFrame:
    return edge_ops.without_disliked(stand_ins.edges(spark, sf), _feedback(spark, sf))


def rating_attach(spark: SparkSession, sf: str) -> DataFrame:
    return edge_ops.with_rating(stand_ins.edges(spark, sf), _feedback(spark, sf))


def boosted_score(spark: SparkSession, sf: str) -> DataFrame:
    boosted = edge_ops.with_boost(stand_ins.edges(spark, sf), _feedback(spark, sf))
    return boosted.withColumn("boost", F.round("boost", 6))


# ------------------------------------------------------------------------ feedback


def feedback_current(spark: SparkSession, sf: str) -> DataFrame:
    return _feedback(spark, sf).select(
        "source_book_id", "candidate_book_id", "label", F.unix_micros("created_at").alias("at")
    )


def feedback_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids given to new ratings: consecutive, and the same on every run."""
    empty = spark.createDataFrame([], FEEDBACK)
    table = feedback_ops.apply_to_feedback(empty, _commands(spark, sf))
    return table.agg(
        F.count("*").alias("n"), F.min("id").alias("lowest"), F.max("id").alias("highest"),
        F.countDistinct("id").alias("n_distinct"),
    )


def feedback_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = feedback_ops.mean_labels(_commands(spark, sf))
    return rows.withColumn("label", F.round("label", 6))


def feedback_exchange(spark: SparkSession, sf: str) -> DataFrame:
    """Current ratings exported as JSON documents and imported again."""
    lines = feedback_json.feedback_entries(_feedback(spark, sf))
    documents = lines.select(F.from_json("value", FEEDBACK_JSON).alias("d")).select("d.*")
    back = feedback_json.feedback_rows(documents)
    return back.select("source_book_id", "candidate_book_id", "label")


def unresolved_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Commands about a book the catalogue does not offer, counted per source file."""
    offered = catalogue_books(eligible(parse_lines(stand_ins.catalogue_lines(spark, sf))))
    have = stand_ins.books(spark, sf).join(offered.select("book"), "book", "left_semi")
    _, unknown = feedback_ops.resolve(stand_ins.commands(spark, sf), have)
    return unknown.groupBy("source_file_name").agg(F.count("*").alias("n"))


def stream_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """All events as a stream of commands; the ratings afterwards."""
    store = _stream(spark, sf)
    return store.feedback().select("source_book_id", "candidate_book_id", "label")


def stream_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edge table after the stream of commands and a compaction."""
    store = _stream(spark, sf)
    store.compact()
    return store.similar()


def stream_state_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """The ratings after the same stream through a state for each pair."""
    return _state(spark, sf).feedback().select("source_book_id", "candidate_book_id", "label")


def stream_state_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges after that stream; nothing is left to fold."""
    return _state(spark, sf).similar()


def _stream(spark: SparkSession, sf: str) -> feedback_stream.FeedbackStore:
    return _fed(spark, sf, feedback_stream, feedback_stream.FeedbackStore)


def _state(spark: SparkSession, sf: str) -> rating_stream.RatingStore:
    return _fed(spark, sf, rating_stream, rating_stream.RatingStore)


def _fed(spark: SparkSession, sf: str, stream, make: Callable):
    store = make(spark, work_path(spark, "feedback"))
    store.replace_similar(stand_ins.edges(spark, sf))
    events = stand_ins.table(spark, sf, "events")
    arriving = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )
    stream.start(
        stand_ins.from_events(arriving),
        lambda: stand_ins.books(spark, sf),
        store,
        work_path(spark, "feedback-state"),
        available_now=True,
    ).awaitTermination()
    return store


def star_map(spark: SparkSession, sf: str) -> DataFrame:
    stars = F.col("l_linenumber")
    label = labels.label_of_stars(stars)
    return stand_ins.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(label, 6).alias("label"),
        labels.stars_of_label(F.col("l_discount") * 10).alias("stars"),
    )


def judge_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of all shapes: the numbers and words of the events, as a judge might reply."""
    events = stand_ins.table(spark, sf, "events")
    answer = (
        F.when(F.col("event_type") == "view", F.col("value").cast("string"))
        .when(F.col("event_type") == "error", F.col("event_type"))
        .when(F.col("event_type") == "signup", F.lit(""))
        .otherwise(F.concat(F.lit(" "), F.floor("value").cast("string"), F.lit(" ")))
    )
    return events.select("event_id", F.round(labels.judge_label(answer), 6).alias("label"))


def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = judge.prompts(stand_ins.edges(spark, sf), stand_ins.books(spark, sf), K)
    return rows.select("source_book_id", "candidate_book_id", "prompt")


def judged_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges labelled by a judge that answers with the length of the prompt, cut to 100."""
    rows = judge.label_edges(
        stand_ins.edges(spark, sf),
        stand_ins.books(spark, sf),
        lambda prompts: [str(min(100, len(p) - 250)) for p in prompts],
        K,
    )
    return rows.select("source_book_id", "candidate_book_id", F.round("label", 6).alias("label"))


def feedback_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Stored ratings after a judge labelled the best edges: its labels take the place of older ratings."""
    store = learn.ratings(spark, work_path(spark, "ratings"))
    store.commit(replaced={"feedback": _feedback(spark, sf)})
    learn.judge_edges(
        store,
        stand_ins.edges(spark, sf),
        stand_ins.books(spark, sf),
        lambda prompts: [str(min(100, len(p) - 250)) for p in prompts],
        K,
    )
    rows = store.read("feedback")
    return rows.select("source_book_id", "candidate_book_id", F.round("label", 6).alias("label"))


# ------------------------------------------------------------------------ learning


def _exported(spark: SparkSession, feedback: DataFrame) -> str:
    path = work_path(spark, "exchange")
    feedback_json.feedback_entries(feedback).write.text(path)
    return path


def feedback_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Stored ratings after a document of half of them took the place of one of all, and a missing one of none."""
    store, all_ = learn.ratings(spark, work_path(spark, "ratings")), _feedback(spark, sf)
    learn.sync(store, _exported(spark, all_))
    learn.sync(store, _exported(spark, all_.where("source_book_id % 2 = 0")))
    learn.sync(store, work_path(spark, "missing"))
    return store.read("feedback").select("source_book_id", "candidate_book_id", "label")


def learning_job(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings taken over from documents, the model trained and saved; scores of the rated pairs."""
    done = learn.learn(
        learn.ratings(spark, work_path(spark, "ratings")),
        _exported(spark, _feedback(spark, sf)),
        stand_ins.vectors(spark, sf),
        stand_ins.edges(spark, sf),
        work_path(spark, "model"),
        _texts(spark, sf),
        work_path(spark, "pairs"),
    )
    return done.report.withColumn("score_now", F.round("score_now", 6))


def train_set_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows = rerank.training_set(_feedback(spark, sf), stand_ins.vectors(spark, sf))
    return rows.withColumn("similarity", F.round("similarity", 9))


def train_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = feedback_ops.text_pairs(_feedback(spark, sf), _texts(spark, sf))
    return rows.withColumn("score", F.round("score", 6))


def edge_score_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.score_report(
        _feedback(spark, sf), stand_ins.edges(spark, sf), stand_ins.vectors(spark, sf)
    )
    return rows.withColumn("score_now", F.round("score_now", 6))


def _steps(spark: SparkSession, sf: str) -> rerank.Steps:
    rows = rerank.training_set(_feedback(spark, sf), stand_ins.vectors(spark, sf))
    return rerank.train(rows)


def rerank_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Best books by the learnt model among all candidates."""
    items = _items(spark, sf)
    return search("exact", items, items, K, steps=_steps(spark, sf))


def rerank_ann(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    index = CellIndex.build(items)
    return search(ANN, items, items, K, index=index, steps=_steps(spark, sf))


def embed_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = encode_by_words(_texts(spark, sf))
    return rows.select(
        "book_id",
        F.size("embedding").alias("dimensions"),
        F.round(vectors.l2_norm("embedding"), 4).alias("norm"),
    )


QUERIES = [
    catalogue_parse, incremental_new_books, author_dim, author_bridge, book_upsert,
    books_of_rated, one_book_per_file, books_with_vectors, vector_count,
    paragraph_sample, fb2_extract, page_extract, archive_listing, archive_members, stream_ingest, stream_members,
    vector_norm, blob_round_trip, blob_components, unit_blobs, cosine_pairs,
    topk_exact_raw, topk_dedup, topk_first_title, topk_other_authors, topk_overfetch,
    topk_cell_bounds, cell_visits,
    ann_full_probe, ann_topk, ann_vs_exact, ann_given_cells, graph_topk, graph_vs_exact, graph_insert,
    similar_of_most_rated, cached_or_compute,
    cached_or_compute_all,
    bulk_ranked_view, bulk_graph_edges, neighbour_graph_recall, documents_similar,
    edges_enriched, edge_export, edge_texts, edge_lists, edge_replace, edge_replace_stored, edges_of_deleted, edges_appended, touched_ids,
    embedding_upsert, author_bridge_again, requests_not_served, book_of_file, vector_of_book, feedback_of_book,
    books_with_edges, file_names, named_books,
    edges_after_dislikes, edges_not_disliked, rating_attach, boosted_score,
    feedback_current, feedback_ids, feedback_mean, feedback_exchange, unresolved_commands,
    stream_feedback, stream_edges, stream_state_feedback, stream_state_edges,
    star_map, judge_labels, judge_prompts, judged_edges, feedback_judged, feedback_replaced, learning_job,
    train_set_rerank, train_pairs, edge_score_report, rerank_exact, rerank_ann, embed_words,
]


def _with_package(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Similar books of every book, as a reader sees them."""
    return queries()["bulk_ranked_view"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {query.__name__: _with_package(query) for query in QUERIES}
    if llm_queries is not None:
        found |= {query.__name__: _with_package(query) for query in llm_queries.QUERIES}
        found["pipeline"] = _with_package(corpus_pipeline.run)
    return found


def oracle_sql() -> dict[str, str]:
    from kindred.plans.sql_twins import TWINS

    found = dict(TWINS)
    if llm_queries is not None:
        found |= llm_queries.TWINS
        if corpus_pipeline.ORACLE_SQL is not None:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
