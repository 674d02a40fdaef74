"""Text to numbers, numbers to text, and tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
WHITESPACE = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    """Trim every kind of ASCII whitespace, not blanks only."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def _numbers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    return F.transform(found, lambda x: x.try_cast("double"))


def range_midpoint(text: Column) -> Column:
    """``"5.0 - 5.5"`` gives 5.25, ``"5.0"`` gives 5.0, text without a number gives null."""
    numbers = _numbers(text)
    return (F.get(numbers, F.lit(0)) + F.get(numbers, F.size(numbers) - 1)) / 2.0


def absent_to_zero(value: Column) -> Column:
    """An element that is not listed is not in the alloy."""
    return F.coalesce(value, F.lit(0.0))


def parse_hardness(text: Column) -> Column:
    """``"64.0 - 66.0 HRC"`` as a struct of lowest and highest reachable value."""
    numbers = _numbers(text)
    return F.struct(
        F.array_min(numbers).alias("hardness_min"),
        F.array_max(numbers).alias("hardness_max"),
    )


def parse_rating(text: Column) -> Column:
    """``"7.0/10"`` gives 7.0; anything that is not ``x/10`` gives null."""
    return F.nullif(
        F.regexp_extract(text, r"^\s*" + NUMBER + r"\s*/\s*10\s*$", 1), F.lit("")
    ).try_cast("double")


def trim_number(value: Column, decimals: int = 1) -> Column:
    """Fixed decimals with a trailing ``.0`` dropped; what is not a finite number counts as 0."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    safe = F.when(finite, number).otherwise(F.lit(0.0))
    return F.regexp_replace(F.format_string(f"%.{decimals}f", safe), r"\.0$", "")


# Words that carry no meaning in a request.
STOPWORDS = (
    "i", "need", "a", "an", "the", "for", "with", "at", "least", "and", "or", "in",
    "around", "to", "grade",
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and hyphens, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z0-9\-]+"), F.lit(0))


def content_tokens(text: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Tokens without stopwords and without pure numbers; order and repeats kept."""
    words = [w for w in stopwords]
    return F.filter(
        tokens(F.coalesce(text, F.lit(""))),
        lambda w: ~w.isin(words) & ~w.rlike("^[0-9]+$"),
    )


def semantic_text(text: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """The free-text part of a request."""
    return F.array_join(content_tokens(text, stopwords), " ")
