"""Column helpers shared by the operators of this package (DataFrame functions only)."""

from __future__ import annotations

import functools
import operator
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        out.append(new)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def split_words(trimmed: Column) -> Column:
    """The words of a text without white space at its ends; the usual single spaces are split without a pattern."""
    other = functools.reduce(operator.or_, (trimmed.contains(F.lit(c)) for c in ("  ", *SPACE_CHARS[1:])))
    return F.when(other, F.split(trimmed, SPACE_RUN)).otherwise(F.split(trimmed, " "))


def words(text: Column) -> Column:
    """The white-space separated words of a text, in order; none for empty or blank text."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def ratio(threshold: float) -> tuple[int, int]:
    """A threshold as an exact fraction, so that size and overlap bounds are integer arithmetic."""
    f = Fraction(str(threshold))
    return f.numerator, f.denominator


def ceil_div(a: Column, b: int) -> Column:
    """ceil(a / b) of non-negative integers."""
    return F.floor((a + (b - 1)) / F.lit(b)).cast("long")
