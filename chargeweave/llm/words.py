"""Column helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (an array of one element, transformed)."""
    return F.transform(F.array(value), body)[0]


def whole_text(column: str = "text") -> Column:
    """The text, '' for null."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of other characters than space and \\x09-\\x0D."""
    return F.array_remove(F.split(text, SPACE_RUN, -1), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_key(source: Column) -> Column:
    """Joins equal sources, null being a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, lengthened until no column has it."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted
