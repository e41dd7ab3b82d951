"""Text expressions: normalisation, lists, slugs, prompts, JSON fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The character classes of words and of file-name slugs. The ASCII ranges
# are part of the Unicode classes; naming them first makes the match faster.
WORD_CHARS = r"a-z0-9_\p{L}\p{N}"
SLUG_OUTSIDE = r"[^0-9a-zA-Z_-]+"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def clean_text(text: Column) -> Column:
    """Lower-case words separated by single spaces; null becomes ''.

    A run of characters outside letters, numbers and ``_`` is one separator, whether it
    is punctuation or white space, so a single pass suffices.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{WORD_CHARS}]+", " "))


def words(text: Column) -> Column:
    """The words of ``clean_text`` as an array, taken from the raw text in one pass."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{WORD_CHARS}]+"), F.lit(0))


def word_array(df: DataFrame, col: str) -> Column:
    """The words of a column: an array is taken as it is, a text is split."""
    return F.col(col) if df.schema[col].dataType.typeName() == "array" else words(F.col(col))


def sentences(text: Column) -> Column:
    """Sentences of a raw text: up to a terminator run or a line end, trimmed, not empty."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def split_list(text: Column) -> Column:
    """Elements of a comma list, stripped and lower-cased, without empty ones."""
    parts = F.transform(F.split(text, ","), lambda x: F.lower(strip_space(x)))
    return F.filter(parts, lambda x: x != "")


def slug(title: Column, suffix: str = ".png") -> Column:
    """A file name from a title."""
    joined = F.regexp_replace(title, SLUG_OUTSIDE, "_")
    return F.concat(F.regexp_replace(joined, "^_+|_+$", ""), F.lit(suffix))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip_space(text) == "")


def prompt(template: str, text: Column) -> Column:
    """``template`` with its one ``{text}`` mark replaced by the column."""
    head, mark, tail = template.partition("{text}")
    if not mark:
        raise ValueError("the template needs a {text} mark")
    return F.concat(F.lit(head), F.coalesce(text, F.lit("")), F.lit(tail))


def json_field(body: Column, path: str = "$.response") -> Column:
    """A field of a JSON reply, stripped; '' where it is absent."""
    return strip_space(F.coalesce(F.get_json_object(body, path), F.lit("")))
