import pytest
from pyspark.sql import functions as F

from kindred.functions import labels, text, vectors
from kindred.functions.display import edge_text, file_url, judge_prompt, percent_text, search_url
from kindred.functions.vectors import cosine, decode_blob, encode_blob, has_direction, l2_norm, normalise
from kindred.operators.extract import sample_plain
from kindred.sources.catalogue import catalogue_books, eligible, parse_lines, scan_catalogue


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long"}
    row = spark.range(1)
    for name, value in values.items():
        kind = "string" if value is None else kinds.get(type(value))
        row = row.withColumn(name, F.lit(value).cast(kind) if kind else F.lit(value))
    return row.select(column.alias("x")).first().x


#: Paragraphs of a text of so many, by how many are taken from each part.
SAMPLED = {
    (0, 5): [], (1, 5): [0, 0], (4, 5): [0, 1, 2, 3, 0, 1, 2, 3], (5, 5): [0, 1, 2, 3, 4, 0, 1, 2, 3, 4],
    (9, 5): [0, 1, 2, 3, 4, 4, 5, 6, 7, 8], (10, 5): [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    (11, 5): [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 6, 7, 8, 9, 10], (12, 5): [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 7, 8, 9, 10, 11],
    (13, 5): [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 8, 9, 10, 11, 12],
    (30, 5): [0, 1, 2, 3, 4, 13, 14, 15, 16, 17, 25, 26, 27, 28, 29],
    (0, 2): [], (1, 2): [0, 0], (4, 2): [0, 1, 2, 3], (5, 2): [0, 1, 2, 3, 3, 4], (9, 2): [0, 1, 3, 4, 7, 8],
    (10, 2): [0, 1, 4, 5, 8, 9], (30, 2): [0, 1, 14, 15, 28, 29],
    (1, 1): [0, 0], (4, 1): [0, 2, 3], (9, 1): [0, 4, 8], (30, 1): [0, 15, 29],
}


@pytest.mark.parametrize(("n", "per_part"), SAMPLED)
def test_sample_paragraphs(spark, n, per_part):
    df = spark.createDataFrame([(1, "\n".join(f" p{i}\t" for i in range(n)))], "id int, text string")
    row = sample_plain(df, per_part=per_part).first()
    assert row.sample == "\n\n".join(f"p{i}" for i in SAMPLED[n, per_part])
    assert row.n_paragraphs == n


def test_sample_header(spark):
    df = spark.createDataFrame(
        [("T", ["A", "B"], "D", "x"), (None, [], None, "x"), ("T", ["A"], "D", " \n ")],
        "title string, authors array<string>, description string, text string",
    )
    got = [r.sample for r in sample_plain(df).collect()]
    assert got == ["T\n\nA, B\n\nD\n\nx\n\nx", "x\n\nx", ""]


@pytest.mark.parametrize(
    "author, wanted",
    [(None, []), ("", []), ("A", ["A"]), (" A , ,B,", ["A", "B"]), (",", [])],
)
def test_author_list(spark, author, wanted):
    assert one(spark, text.author_list(F.col("a")), a=author) == wanted


@pytest.mark.parametrize(
    "field, wanted",
    [("Last,First,Mid:Last2,First2:", ["Last First Mid", "Last2 First2"]), ("", []), ("Solo", ["Solo"]),
     (" A , B : ", ["A B"])],
)
def test_catalogue_authors(spark, field, wanted):
    assert one(spark, text.catalogue_authors(F.col("a")), a=field) == wanted


def line(*fields):
    return "\x04".join(fields)


def test_catalogue_lines(spark):
    full = line("L,F:", "g", "Title", "", "", "17", "9", "17", "0", "fb2", "2020", "ru", "", "")
    rows = [
        ("a/lib-1.inp", full),
        ("lib-1.inp", full.replace("\x0417\x049\x0417\x040", "\x0418\x049\x0418\x041")),  # deleted
        ("lib-1.inp", full.replace("ru", "en")),
        ("lib-1.inp", line("L", "g", "T2")),  # short
        ("lib-1.inp", "   "),
        ("lib-1.inp", full.replace("\x0417\x04", "\x04\x04", 1)),  # no file
        ("version.info", "20240101"),
    ]
    records = parse_lines(spark.createDataFrame(rows, "member string, line string"))
    assert records.count() == 6
    books = catalogue_books(eligible(records)).collect()
    assert [(b.archive, b.book, b.title, b.author, b.authors) for b in books] == [
        ("a/lib-1.zip", "17.fb2", "Title", "L F", ["L F"])
    ]
    assert eligible(records, "en").count() == 1


def test_unknown_catalogue(spark):
    with pytest.raises(ValueError):
        scan_catalogue(spark, "csv", "/nowhere", spark.createDataFrame([], "book string"))


def test_vectors(spark):
    df = spark.createDataFrame(
        [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1e-10, 0.0]), (4, None)], "id int, v array<float>"
    )
    rows = df.select("id", l2_norm("v").alias("n"), normalise("v").alias("u"),
                     normalise("v", zero_as_null=False).alias("z"), has_direction("v").alias("d"),
                     cosine("v", "v").alias("c")).orderBy("id").collect()
    assert [r.n for r in rows][:2] == [5.0, 0.0] and rows[3].n is None
    assert rows[0].u == pytest.approx([0.6, 0.8]) and rows[1].u is None and rows[2].u is None
    assert rows[1].z == [0.0, 0.0] and [r.d for r in rows] == [True, False, False, False]
    assert rows[0].c == pytest.approx(1.0) and rows[1].c is None
    back = df.select("id", encode_blob("v").alias("b")).select("id", "b", decode_blob("b").alias("v"))
    got = {r.id: (r.b, r.v) for r in back.collect()}
    assert len(got[1][0]) == 8 and got[1][1] == [3.0, 4.0] and got[4] == (None, None)


@pytest.mark.parametrize("answer, label", [("85", 0.85), (" 85 ", 0.85), ("eighty", None), ("", None),
                                           (None, None), ("85.5", None), ("-5", -0.05), ("+7", 0.07)])
def test_judge_label(spark, answer, label):
    got = one(spark, labels.judge_label(F.col("a")), a=answer)
    assert got == (None if label is None else pytest.approx(label))


@pytest.mark.parametrize("label, stars", [(1.0, 5), (0.6, 3), (0.5, 3), (0.1, 1), (0.0, 0), (-1.0, -5)])
def test_stars(spark, label, stars):
    assert one(spark, labels.stars_of_label(F.col("a")), a=label) == stars


def test_label_expressions(spark):
    assert one(spark, labels.unit_interval(F.col("a")), a=-1.0) == 0.0
    assert one(spark, labels.sample_weight(F.col("a")), a=-0.1) == 1.2
    assert one(spark, labels.sample_weight(F.col("a")), a=0.4) == 1.0
    assert one(spark, labels.boost(F.col("a").cast("double")), a=None) == 0.0
    assert one(spark, labels.boost(F.col("a")), a=0.5) == pytest.approx(0.2)


def test_display(spark):
    assert one(spark, file_url("http://lib", F.col("f")), f="book.fb2") == (
        "http://lib/#/extended?page=1&limit=20&ex_file=book"
    )
    assert one(spark, file_url("", F.col("f")), f="a.fb2.zip").endswith("a.fb2.zip")
    assert one(spark, percent_text(F.col("s")), s=0.42) == " 42.00"
    assert one(spark, search_url("u", "title", F.col("v")), v="A b") == "u/#/title?title=A b"
    assert one(spark, search_url("u", "author", F.col("v"), encode=True), v="A b") == "u/#/author?author=A+b"
    with pytest.raises(ValueError):
        search_url("u", "year", F.lit(""))
    assert one(spark, edge_text(F.lit(0.1234), F.lit(5), F.lit(6))) == "0.123 — 5 → 6"
    prompt = one(spark, judge_prompt(F.lit("T"), F.lit(None).cast("string"), F.lit("C"), F.lit("A")))
    assert "Название: T\n    Автор: None\n" in prompt and prompt.startswith("\n    Оцени")


def test_stored_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, []), (5, [1e-10, 0.0]), (6, [-2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>").coalesce(1)
    blobs = df.select("id", vectors.vector_to_store("v").alias("b"), vectors.encode_blob("v").alias("raw"))
    got = {r.id: (r.b, r.back, r.raw) for r in blobs.select("*", vectors.stored_vector("b").alias("back"), vectors.decode_blob("raw").alias("r")).collect()}
    assert got[1][1] == pytest.approx([0.6, 0.8]) and got[6][1] == [-1.0, 0.0, 0.0]
    assert got[2] == (None, None, None) and [got[k][1] for k in (3, 4, 5)] == [None] * 3
    assert bytes(got[3][0]) == bytes(8) == bytes(got[5][0]) and bytes(got[4][0]) == b""
    assert {r.id: r.r for r in blobs.select("id", vectors.decode_blob("raw").alias("r")).collect()} == {k: v if v is None else [pytest.approx(x) for x in v] for k, v in rows}
    assert blobs.limit(0).select(vectors.stored_vector("b")).count() == 0
    broken = spark.createDataFrame([(bytearray(b"abc"),)], "b binary")
    with pytest.raises(Exception, match="whole float32"):
        broken.select(vectors.decode_blob("b")).collect()
