"""Column expressions shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six ASCII blanks: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column | str) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column | str) -> Column:
    """Runs of characters that aren't blanks."""
    return F.regexp_count(whole(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))
