import zipfile

import pytest

from kindred.operators.extract import describe, read_markup
from kindred.plans.ingest import Library, add_books, backfill_authors, read_books, with_ids
from kindred.schemas import AUTHORS, BOOK_AUTHORS, BOOKS, EMBEDDINGS
from kindred.operators.encode import encode, encode_by_words
from kindred.sources.archives import list_members, read_lines, read_members, split_errors
from kindred.sources.catalogue import scan_catalogue
from kindred.streaming import ingest

NS = "http://www.gribuser.ru/xml/fictionbook/2.0"


def book(body, title="T", authors=(("F", "M", "L"),), annotation="", doc_id="id-1", prefix=""):
    p = prefix and prefix + ":"
    people = "".join(
        f"<{p}author><{p}first-name>{f}</{p}first-name>"
        + (f"<{p}middle-name>{m}</{p}middle-name>" if m else "")
        + f"<{p}last-name>{l}</{p}last-name></{p}author>"
        for f, m, l in authors
    )
    space = f'xmlns:{prefix}="{NS}"' if prefix else f'xmlns="{NS}"'
    head = f"<{p}book-title>{title}</{p}book-title>" if title is not None else ""
    return (
        f'<?xml version="1.0" encoding="utf-8"?><{p}FictionBook {space}><{p}description><{p}title-info>'
        f"{people}{head}{annotation}</{p}title-info><{p}document-info><{p}author><{p}first-name>Scan"
        f"</{p}first-name></{p}author><{p}id> {doc_id} </{p}id></{p}document-info></{p}description>"
        f"<{p}body>{body}</{p}body></{p}FictionBook>"
    )


def paragraphs(n, p=""):
    return "".join(f"<{p}p>p{i}</{p}p>" for i in range(n))


CASES = {
    "plain": (book(paragraphs(2)), ["p0", "p1"]),
    "prefixed": (book(paragraphs(2, "f:"), prefix="f"), ["p0", "p1"]),
    "other namespace": (book(paragraphs(2)).replace(NS, "urn:x"), []),
    "notes": (book("<note><p>n</p></note><section><annotation><p>a</p></annotation><p>x</p></section>"), ["x"]),
    "inline markup": (book("<p>one <b>two</b> three</p>"), ["one", "three"]),
    "comment": (book("<p>one<!-- c -->two</p>"), ["one", "two"]),
    "entities": (book("<p>a &amp; b &#1041;</p><p>   </p>"), ["a & b Б"]),
    "unclosed": (book("<p>one<p>two</p>"), ["one", "two"]),
    "bad entity": (book("<p>one &nbsp; two</p>"), None),
    "cp1251": (book("<p>Б</p>").replace("utf-8", "windows-1251").encode("cp1251"), ["Б"]),
}


@pytest.mark.parametrize("name", CASES)
def test_paragraphs(spark, name):
    content, wanted = CASES[name]
    raw = content if isinstance(content, bytes) else content.encode()
    df = spark.createDataFrame([(1, bytearray(raw))], "id int, content binary")
    row = read_markup(df, per_part=None).first()
    assert row.error is None
    if wanted is None:
        assert row.n_paragraphs == 1 and row.paragraphs[0].startswith("one")
    else:
        assert row.paragraphs == wanted


def test_metadata(spark):
    annotation = "<annotation><p> d1 </p><p/><p>d2</p></annotation>"
    rows = [
        (1, book(paragraphs(1), "  My\n title ", [("A", "B", "C"), ("D", "", "E")], annotation)),
        (2, book(paragraphs(1), None, [], doc_id="")),
        (3, book("", "Only title")),
        (4, None),
    ]
    df = spark.createDataFrame(rows, "id int, content string")
    got = {r.id: r for r in describe(read_markup(df)).collect()}
    assert (got[1].title, got[1].authors, got[1].description, got[1].uid) == (
        "My\n title", ["A B C", "D E"], "d1\nd2", "id-1"
    )
    assert got[1].sample == "My\n title\n\nA B C, D E\n\nd1\nd2\n\np0\n\np0"
    assert (got[2].title, got[2].authors, got[2].description, got[2].uid) == (None, [], None, None)
    assert got[3].sample == "" and got[3].title == "Only title"
    assert got[4].error == "no content"


def write_zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, data in members.items():
            out.writestr(name, data)


@pytest.fixture
def library(tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    write_zip(folder / "one.ZIP", {"1.fb2": book(paragraphs(12), "One"), "dir/": "", "2.fb2": book("<p>x", None, [])})
    write_zip(folder / "two.zip", {"3.fb2": book(paragraphs(3), "Three", [("A", "", "Z")])})
    (folder / "broken.zip").write_bytes(b"no zip")
    (folder / "readme.txt").write_text("x")
    fields = ["X,Y:", "", "Known", "", "", "1", "", "", "0", "fb2", "", "ru", "", ""]
    lines = ["\x04".join(fields), "\x04".join(fields[:5] + ["9"] + fields[6:]), ""]
    write_zip(tmp_path / "lib.inpx", {"one.inp": "\r\n".join(lines), "structure.info": "AUTHOR"})
    return folder


def test_listing_and_reading(spark, library):
    listed = list_members(spark, str(library))
    good, bad = split_errors(listed)
    assert {(r.archive, r.member) for r in good.collect()} == {
        ("one.ZIP", "1.fb2"), ("one.ZIP", "2.fb2"), ("two.zip", "3.fb2")
    }
    assert [r.archive for r in bad.collect()] == ["broken.zip"]
    extra = good.unionByName(good.where("member = '3.fb2'").withColumn("member", good.archive))
    got = {(r.archive, r.member): r for r in read_members(extra).collect()}
    assert got["two.zip", "3.fb2"].content.decode() == book(paragraphs(3), "Three", [("A", "", "Z")])
    assert got["two.zip", "two.zip"].content is None and "two.zip" in got["two.zip", "two.zip"].error
    lines = read_lines(list_members(spark, str(library.parent / "lib.inpx"), glob=None)).collect()
    assert len(lines) == 3 and {r.member for r in lines} == {"one.inp", "structure.info"}


def empty_library(spark):
    return Library(*[spark.createDataFrame([], s) for s in (BOOKS, EMBEDDINGS, AUTHORS, BOOK_AUTHORS)])


def test_ingestion_from_the_catalogue(spark, library):
    start = empty_library(spark)
    found, rejected = scan_catalogue(spark, "inpix", str(library.parent / "lib.inpx"), start.books)
    assert rejected.count() == 0
    # The catalogue says one.zip; the second book has no document.
    rows = read_books(with_ids(found, start.books), str(library)).cache()
    assert {(r.book, r.error is None) for r in rows.collect()} == {("1.fb2", False), ("9.fb2", False)}


def test_ingestion_from_archives(spark, library):
    start = empty_library(spark)
    found, _ = scan_catalogue(spark, "zip", str(library), start.books)
    read = read_books(with_ids(found, start.books), str(library)).cache()
    assert read.where("error IS NOT NULL").count() == 0
    done = add_books(start, read.drop("error"), lambda t: encode_by_words(t, dimensions=32))
    books = {r.book: r for r in done.books.collect()}
    assert sorted(r.id for r in books.values()) == [1, 2, 3]
    assert (books["1.fb2"].title, books["1.fb2"].author, books["1.fb2"].uid) == ("One", "F M L", "id-1")
    assert (books["2.fb2"].title, books["2.fb2"].author) == (None, "")
    assert {len(r.embedding) for r in done.embeddings.collect()} == {32}
    assert {r.name for r in done.authors.collect()} == {"F M L", "A Z"}
    assert done.book_authors.count() == 2
    # Nothing is new the second time; a repeated add keeps every id.
    assert scan_catalogue(spark, "zip", str(library), done.books)[0].count() == 0
    again = add_books(done, read.drop("error"), lambda t: encode_by_words(t, dimensions=32))
    assert {(r.id, r.book) for r in again.books.collect()} == {(r.id, r.book) for r in books.values()}
    assert again.authors.count() == 2 and again.book_authors.count() == 2
    # Books that lost their authors get them back from the documents.
    bare = Library(done.books, done.embeddings, start.authors, start.book_authors)
    assert {r.name for r in backfill_authors(bare, str(library)).authors.collect()} == {"F M L", "A Z"}


def test_encoder_is_called_in_batches(spark):
    import numpy as np

    def make():
        return lambda texts: np.array([[len(t), 1.0, 0.0] if t else [0.0, 0.0, 0.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([(1, "aa"), (2, ""), (3, None)], "id int, sample string")
    got = {r.id: r.embedding for r in encode(df, make).collect()}
    assert got[1] == pytest.approx([2 / 5**0.5, 1 / 5**0.5, 0]) and got[2] == got[3] == [0.0, 0.0, 0.0]


def test_archives_as_a_stream(spark, library, tmp_path):
    store = ingest.LibraryStore(spark, str(tmp_path / "store"))

    def run():
        ingest.start(
            ingest.archive_stream(spark, str(library)), ingest.books_of_archives, str(library), store,
            lambda t: encode_by_words(t, dimensions=16, weigh=False), str(tmp_path / "state"), available_now=True,
        ).awaitTermination()

    run()
    assert store.table("books").count() == 3
    assert [r.archive for r in store.table("rejected").collect()] == ["broken.zip"]
    write_zip(library / "three.zip", {"3.fb2": book(paragraphs(1), "Copy"), "4.fb2": book(paragraphs(1), "Four")})
    run()
    books = {r.book: r for r in store.table("books").collect()}
    assert set(books) == {"1.fb2", "2.fb2", "3.fb2", "4.fb2"} and books["3.fb2"].title == "Three"
    assert len({r.id for r in books.values()}) == 4 and store.table("embeddings").count() == 4
    assert store.table("book_authors").count() == 3 and store.table("authors").count() == 2


def test_half_done_batch_is_finished_by_its_replay(spark, library, tmp_path, monkeypatch):
    store = ingest.LibraryStore(spark, str(tmp_path / "store"))
    found, broken = ingest.books_of_archives(list_members(spark, str(library)).select("path").distinct())
    encoder = lambda t: encode_by_words(t, dimensions=16, weigh=False)
    write = store.store._write
    monkeypatch.setattr(store.store, "_write", lambda name, *a: write(name, *a) if name != "authors" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.add(found, str(library), encoder, "q-0")
    assert store.table("books").count() == store.table("embeddings").count() == 0
    monkeypatch.undo()
    store.add(found, str(library), encoder, "q-0", broken)
    store.add(found, str(library), encoder, "q-0", broken)
    ids = sorted(r.id for r in store.table("books").collect())
    assert ids == sorted(r.book_id for r in store.table("embeddings").collect()) == [1, 2, 3]
    assert store.table("book_authors").count() == 2


def test_catalogue_lines_as_a_stream(spark, library, tmp_path):
    lines = tmp_path / "lines"
    lines.mkdir()
    fields = ["X,Y:", "", "Known", "", "", "3", "", "", "0", "fb2", "", "ru", "", ""]
    (lines / "two.inp").write_text("\x04".join(fields) + "\n\n")
    store = ingest.LibraryStore(spark, str(tmp_path / "store"))
    ingest.start(
        ingest.line_stream(spark, str(lines)), ingest.books_of_lines, str(library), store,
        lambda t: encode_by_words(t, dimensions=16, weigh=False), str(tmp_path / "state"), available_now=True,
    ).awaitTermination()
    row = store.table("books").first()
    assert (row.book, row.archive, row.title, row.author, row.uid) == ("3.fb2", "two.zip", "Known", "X Y", "id-1")


def test_what_a_catalogue_loses_is_told(spark, tmp_path):
    line = "\x04".join(["A,B,:", "", "T", "", "", "7", "1", "7", "0", "fb2", "", "ru", "", ""])
    with zipfile.ZipFile(tmp_path / "lib.inpx", "w") as out:
        out.writestr("one.inp", line.encode() + b"\r\n\xff\xfe broken\r\n" + line.replace("\x047\x04", "\x048\x04", 1).encode())
    (tmp_path / "broken.inpx").write_bytes(b"no archive")
    found, rejected = scan_catalogue(spark, "inpix", str(tmp_path / "lib.inpx"), empty_library(spark).books)
    assert {r.book for r in found.collect()} == {"7.fb2", "8.fb2"}
    assert [(r.member, "UnicodeDecodeError" in r.error) for r in rejected.collect()] == [("one.inp", True)]
    found, rejected = scan_catalogue(spark, "inpix", str(tmp_path / "broken.inpx"), empty_library(spark).books)
    assert found.count() == 0 and [r.archive for r in rejected.collect()] == ["broken.inpx"]


def test_texts_are_handled_in_pieces():
    """documents and prompts of a batch become Python objects a piece at a time; order and nulls stay."""
    import pyarrow as pa

    from kindred.sources.archives import pieces

    texts = ["a" * 300, None, "b" * 10, "c" * 5_000, "", "d" * 400] * 50
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "content": texts})
    found = list(pieces(batch, "content", 2_000))
    assert pa.Table.from_batches(found).to_pydict() == batch.to_pydict()
    sizes = [sum(len(x or "") for x in p.column("content").to_pylist()) for p in found]
    assert len(found) > 40 and max(sizes) < 2_000 + 5_000
    assert list(pieces(batch.slice(0, 0), "content")) == []


def test_parsed_rows_of_large_batches(spark):
    """rows of several pieces keep their columns, whatever their types."""
    docs = spark.range(40).selectExpr(
        "id AS doc_id", "timestamp_seconds(id) AS at", "array(id) AS held",
        "concat('<FictionBook xmlns=\"http://www.gribuser.ru/xml/fictionbook/2.0\"><body><section><p>', repeat(cast(id AS string), 90000), '</p></section></body></FictionBook>') AS content",
    )
    rows = {r.doc_id: r for r in read_markup(docs).collect()}
    assert len(rows) == 40 and all(r.held == [i] and r.n_paragraphs == 1 for i, r in rows.items())
    assert rows[7].at == spark.sql("SELECT timestamp_seconds(7)").first()[0] and set(rows[7].paragraphs) == {"7" * 90000}
