"""A corpus made ready for training: five stages over ``documents``, each one of the operators.

A stage takes (spark, docs, sf_dir) and gives the rows it keeps, with the columns of ``documents``; the
last gives the pieces of the packed sequences. Between stages the rows are written as Parquet and
read again. Rows with null text pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import jaccard, packing, pii, repeats, toxicity
from kindred.llm.common import staged, table
from kindred.llm.queries import tokenizer


def _counted(docs: DataFrame) -> DataFrame:
    """The rows with the number of characters their text now has; null text keeps what it had, and so does
    a table without that column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the toxicity model rejects go.

    Null and empty texts, and rows without an id, stay unless the model rejects the empty text; rows that
    repeat go or stay together. No labels, or of one kind only: fixed weights. No rows give none."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that n-gram Jaccard links join (five words, 0.8), the smallest id stays.

    Rows that repeat an id stay or go together. Null, empty and blank texts link with nothing and stay, rows
    without an id too. No rows give none."""
    return jaccard.without_copies(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier in the corpus go from the text.

    Earlier is a smaller id, or an earlier place of the same text; characters go whole. Null text stays null;
    rows that repeat are one text, and rows without an id are left as they are. No row goes."""
    return _counted(repeats.without_repeats(docs, length=100))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. Null text stays null; no row goes."""
    return _counted(pii.masked(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts, packed into sequences of 2048 tokens.

    Null and empty texts are one token; every row is a document of its own. No rows give none."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), limit=2048)


STAGES = [
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("best-fit packing", packed),
]
#: SQL can state neither the learnt model nor the packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = staged(stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return rows
