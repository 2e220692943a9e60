"""Text and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

PARAGRAPHS_PER_PART = 5
PART_SEPARATOR = "\n\n"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def non_empty(c: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def clean_list(items: Column) -> Column:
    """Strip every element and drop the empty ones."""
    return F.filter(F.transform(items, strip), lambda x: x != "")


def author_list(author: Column) -> Column:
    """``"A, B"`` -> ``["A", "B"]``; null or empty gives an empty list."""
    return clean_list(F.split(F.coalesce(author, F.lit("")), ","))


def catalogue_authors(field: Column) -> Column:
    """``"Last,First,Middle:Last,First"`` -> ``["Last First Middle", "Last First"]``.

    An entry of separators only (``","``) is kept as an empty name, an empty entry is not.
    """
    return F.transform(
        clean_list(F.split(field, ":")),
        lambda entry: F.array_join(clean_list(F.split(entry, ",")), " "),
    )


def person_name(person: Column) -> Column:
    """First, middle and last name of a struct, joined by blanks, empty parts skipped."""
    parts = F.array(
        person.getField("first"), person.getField("middle"), person.getField("last")
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def person_names(people: Column) -> Column:
    return F.filter(F.transform(people, person_name), lambda n: n != "")


def fallback(preferred: Column, other: Column) -> Column:
    """The preferred text unless it is null or empty."""
    return F.when(preferred.isNull() | (preferred == ""), other).otherwise(preferred)


def fallback_list(preferred: Column, other: Column) -> Column:
    return F.when(F.coalesce(F.size(preferred), F.lit(0)) > 0, preferred).otherwise(other)


def sample_paragraphs(paragraphs: Column, per_part: int = PARAGRAPHS_PER_PART) -> Column:
    """First, middle and last paragraphs.

    The middle part exists only when there are more than two parts' worth of
    paragraphs; head and tail may overlap and then repeat paragraphs.
    """
    if per_part <= 0:
        raise ValueError("per_part must be positive")
    n = F.size(paragraphs)
    head = F.slice(paragraphs, F.lit(1), F.lit(per_part))
    middle_at = F.greatest(F.lit(per_part), F.floor(n / 2).cast("int") - F.lit(per_part // 2))
    middle = F.when(
        n > per_part * 2, F.slice(paragraphs, middle_at + F.lit(1), F.lit(per_part))
    ).otherwise(F.slice(paragraphs, F.lit(1), F.lit(0)))
    tail = F.slice(paragraphs, F.greatest(n - F.lit(per_part), F.lit(0)) + F.lit(1), F.lit(per_part))
    return F.concat(head, middle, tail)


def sample_text(
    paragraphs: Column,
    title: Column,
    authors: Column,
    description: Column,
    per_part: int = PARAGRAPHS_PER_PART,
) -> Column:
    """Text that stands for the document: header lines, then sampled paragraphs.

    A document without paragraphs gives an empty text, whatever its header says.
    """
    author_line = F.when(F.size(authors) > 0, F.array_join(authors, ", "))
    header = F.filter(
        F.array(title, author_line, description), lambda x: x.isNotNull() & (x != "")
    )
    parts = F.concat(header, sample_paragraphs(paragraphs, per_part))
    return F.when(F.size(paragraphs) > 0, F.array_join(parts, PART_SEPARATOR)).otherwise("")
