"""What the operators share: lambda bindings, digests, joins with a measured side, batches in Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

#: ASCII white space, as a character class and as the characters themselves.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows up to which a lookup table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it.

    An expression named inside the lambda of a higher-order function is evaluated again for each
    element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other letters as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def space_words(text: Column) -> Column:
    """The words between ASCII white space; none for an empty text."""
    for other in SPACE_CHARS[1:]:
        text = F.replace(text, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of this regular class (without its brackets) the text has."""
    return F.regexp_count(text, F.lit(f"[{characters}]")).cast("bigint")


def join_small(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a written table: broadcast when its counted rows are few, else by shuffle."""
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right, on, how)


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches cut into smaller ones, so that only few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
