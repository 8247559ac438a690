"""String rules of the panels and documents. All are built-in column expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["alias", "chapter", "contains_keyword", "id_number", "listed", "mapped", "name_or_unknown", "normal_name", "plain_quotes", "preview", "product", "snake_key", "spaced", "split_list", "zero_padded"]


def mapped(column: Column, names: Mapping[str, str]) -> Column:
    """The name that a small dictionary has for a value, else null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), column)


def plain_quotes(column: Column) -> Column:
    """Curly quotes as straight ones, without blanks around."""
    return F.trim(F.translate(column, "‘’“”", "''\"\""))


def zero_padded(column: Column, width: int) -> Column:
    """Zeros in front up to width; what is longer stays as it is."""
    return F.when(F.length(column) < width, F.lpad(column, width, "0")).otherwise(column)


def chapter(column: Column) -> Column:
    """The chapter of a goods code: two digits after dots and letters are gone, null where there are none."""
    return F.substring(F.regexp_replace(column, r"[^0-9]", ""), 1, 2).try_cast("int")


def id_number(column: Column, prefix: str) -> Column:
    return F.regexp_replace(column, "^" + prefix, "").try_cast("int")


def split_list(column: Column) -> Column:
    """Items between ; or |, without blanks around and without empty ones."""
    return F.filter(F.transform(F.split(column, r"[;|]"), lambda x: F.trim(x)), lambda x: x != "")


def listed(column: Column) -> Column:
    """Items of a list literal ['a', "b"]; anything else is split_list's."""
    inside = F.transform(F.regexp_extract_all(column, F.lit("'([^']*)'|\"([^\"]*)\""), F.lit(0)), lambda x: F.trim(F.substring(x, F.lit(2), F.length(x) - 2)))
    return F.when(column.rlike(r"^\s*\["), F.filter(inside, lambda x: x != "")).otherwise(split_list(column))


def product(title: Column) -> Column:
    """What follows the first dash between blanks in a title, without a remark in brackets at the end."""
    after = F.when(F.instr(title, " - ") > 0, F.substring(title, F.instr(title, " - ") + 3, F.length(title))).otherwise(title)
    return F.trim(F.regexp_replace(after, r"\s*\([^)]*\)\s*$", ""))


def normal_name(column: Column) -> Column:
    """Lower case, without a leading article and without punctuation at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), r"^the ", ""), r"[,;:!*]+$", ""))


def alias(column: Column, names: Mapping[str, str]) -> Column:
    """The name that the dictionary has for a value, with or without a full stop at its end, else the value."""
    bare = F.regexp_replace(column, r"\.$", "")
    return F.coalesce(mapped(column, names), mapped(bare, names), mapped(F.concat(column, F.lit(".")), names), column)


def spaced(column: Column) -> Column:
    """White space as one blank, a blank between a small letter and a digit that follows, and one between Art. and a
    capital, as of a Roman number."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(column, r"\s+", " ")), r"([a-z])([0-9])", "$1 $2"), r"Art\.([A-Z])", "Art. $1")


def snake_key(column: Column, special: Mapping[str, str] = {}) -> Column:  # noqa: B006
    """A heading as a key: lower case, runs of other characters than letters and digits as one underscore."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(mapped(key, special), key) if special else key


def contains_keyword(title: Column, text: Column) -> Column:
    """Whether a title's word of more than three letters, or any of its words if it has none such, occurs in text."""
    words = F.filter(F.split(F.lower(title), r"\s+"), lambda w: w != "")
    long = F.filter(words, lambda w: F.length(w) > 3)
    return F.exists(F.when(F.size(long) > 0, long).otherwise(words), lambda w: F.contains(F.lower(text), w))


def preview(column: Column, n: int, suffix: str = "") -> Column:
    """The first n characters, and the suffix where something was cut."""
    return F.when(F.length(column) > n, F.concat(F.substring(column, 1, n), F.lit(suffix))).otherwise(column)


def name_or_unknown(items: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(items, ", "), F.lit("")), F.lit("Unknown"))
