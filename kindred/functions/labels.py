"""Feedback labels: ratings, judge scores, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.text import strip

# Fixed values of the rating scale.
STAR_STEP = 0.2
DISLIKE = -1.0
NO_RATING = 0.0
BOOST_FACTOR = 0.4
NEGATIVE_WEIGHT = 1.2


def label_of_stars(stars: Column) -> Column:
    return stars * F.lit(STAR_STEP)


def stars_of_label(label: Column) -> Column:
    """Nearest star count, halves rounded up."""
    return F.floor(label / F.lit(STAR_STEP) + F.lit(0.5)).cast("int")


def judge_label(answer: Column) -> Column:
    """A judge's answer 0..100 as a label; null unless the answer is one whole number."""
    text = strip(answer)
    return F.when(
        text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint").cast("double") / F.lit(100.0)
    )


def unit_interval(label: Column) -> Column:
    """Rescale -1..1 to 0..1."""
    return (label + F.lit(1.0)) / F.lit(2.0)


def sample_weight(label: Column) -> Column:
    return F.when(label < 0, F.lit(NEGATIVE_WEIGHT)).otherwise(F.lit(1.0))


def is_rated(label: Column) -> Column:
    return label != F.lit(NO_RATING)


def boost(label: Column, factor: float = BOOST_FACTOR) -> Column:
    return F.coalesce(label, F.lit(0.0)) * F.lit(factor)


def feedback_time(text: Column) -> Column:
    """Time given as ISO text, or now when it is missing or unreadable."""
    return F.coalesce(F.try_to_timestamp(F.nullif(text, F.lit(""))), F.current_timestamp())
