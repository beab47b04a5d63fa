"""Text helpers shared by the other expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character at which a text is broken into lines, and every character stripped as white space.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_SPACE, "")


def text_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def complete_rows(*columns: Column, required: tuple[str, ...]) -> Column:
    """The columns as a row, left out when a required one is null.

    A filter above a projection would be pushed below it and compute the filtered column a second time; here each
    expression is evaluated once.
    """
    def complete(row: Column) -> Column:
        found = row[required[0]].isNotNull()
        for name in required[1:]:
            found = found & row[name].isNotNull()
        return found

    return F.inline(F.filter(F.array(F.struct(*columns)), complete))


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
