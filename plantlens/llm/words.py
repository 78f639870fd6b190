"""What the text operators agree on: words are runs of anything but the six ASCII white-space characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is missing."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_array(text: Column) -> Column:
    """The words in order; an empty array for a text without any."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them: the parts between gaps, less the empty ones at both ends."""
    parts = F.split(text, GAP)
    ends = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, 0).otherwise(F.size(parts) - ends).cast("long")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, also where a lambda in `body` uses it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
