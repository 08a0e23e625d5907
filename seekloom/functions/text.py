"""Text clean-up, language ratio and path helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(text: Column | str) -> Column:
    """Collapse white space, then turn bullet runs into one space, then trim.

    The order is part of the result: ``a • b`` keeps three spaces between the letters.
    """
    collapsed = F.regexp_replace(_col(text), r"\s+", " ")
    return F.trim(F.regexp_replace(collapsed, r"[•·]+", " "))


def english_ratio(text: Column | str) -> Column:
    """ASCII letters of the lowered text over its length; 0.0 for null or empty text."""
    text = _col(text)
    letters = F.length(F.regexp_replace(F.lower(text), r"[^a-z]+", ""))
    return F.when(F.length(text) > 0, letters / F.length(text)).otherwise(F.lit(0.0))


def basename(path: Column | str) -> Column:
    """The part of a path after its last slash."""
    return F.substring_index(_col(path), "/", -1)
