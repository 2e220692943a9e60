"""Table schemas of the data model."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    FloatType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _table(*columns: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns])


BOOKS = _table(
    ("id", LongType()),
    ("book", StringType()),
    ("archive", StringType()),
    ("uid", StringType()),
    ("title", StringType()),
    ("author", StringType()),
    ("added_at", TimestampType()),
)

EMBEDDINGS = _table(("book_id", LongType()), ("embedding", ArrayType(FloatType())))

AUTHORS = _table(("id", LongType()), ("name", StringType()))

BOOK_AUTHORS = _table(("book_id", LongType()), ("author_id", LongType()))

SIMILAR = _table(
    ("book_id", LongType()), ("similar_book_id", LongType()), ("score", DoubleType())
)

FEEDBACK = _table(
    ("id", LongType()),
    ("source_book_id", LongType()),
    ("candidate_book_id", LongType()),
    ("label", DoubleType()),
    ("created_at", TimestampType()),
)

# One feedback command as a reader sends it, plus the time and number that order commands.
COMMANDS = _table(
    ("source_file_name", StringType()),
    ("candidate_file_name", StringType()),
    ("label", DoubleType()),
    ("created_at", TimestampType()),
    ("command_id", LongType()),
)

# Feedback exchange document: {"feedback": [{...}, ...]}
FEEDBACK_JSON = StructType(
    [
        StructField(
            "feedback",
            ArrayType(
                _table(
                    ("source_id", LongType()),
                    ("candidate_id", LongType()),
                    ("label", DoubleType()),
                    ("created_at", StringType()),
                )
            ),
        )
    ]
)
