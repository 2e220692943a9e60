"""What a reader sees: links, percentages, prompts, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_VALUE = "—"

# Fixed text: what a judge is asked. %s are title and author of source and candidate.
JUDGE_PROMPT = """
    Оцени похожесть между двумя книгами от 0 до 100.
    0: совсем не похожи, не понравится читателю
    100: очень похожи, понравится читателю
    
    Исходная книга:
    Название: %s
    Автор: %s
    
    Кандидат:
    Название: %s
    Автор: %s
    
    Ответь только целым числом от 0 до 100 без пояснений.
    """


def file_url(base: str, file_name: Column) -> Column:
    """Library search link for a file, without the book suffix."""
    stem = F.regexp_replace(file_name, r"\.fb2\z", "")
    return F.concat(F.lit(f"{base}/#/extended?page=1&limit=20&ex_file="), stem)


def search_url(base: str, kind: str, value: Column, encode: bool = False) -> Column:
    """Library link that searches by ``title`` or ``author``."""
    if kind not in ("title", "author"):
        raise ValueError(f"unknown search kind: {kind}")
    return F.concat(
        F.lit(f"{base}/#/{kind}?{kind}="), F.url_encode(value) if encode else value
    )


def percent(score: Column) -> Column:
    return F.round(score * 100, 2)


def percent_text(score: Column) -> Column:
    """Two decimals, padded to six characters."""
    return F.format_string("%6.2f", score * 100)


def edge_text(score: Column, source_id: Column, candidate_id: Column) -> Column:
    return F.format_string("%.3f — %d → %d", score, source_id, candidate_id)


def authors_text(authors: Column) -> Column:
    return F.when(F.size(authors) > 0, F.array_join(authors, ", ")).otherwise(NO_VALUE)


def judge_prompt(
    source_title: Column, source_author: Column, title: Column, author: Column
) -> Column:
    shown = [F.coalesce(c, F.lit("None")) for c in (source_title, source_author, title, author)]
    return F.format_string(JUDGE_PROMPT, *shown)
