"""Column helpers shared by the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six ASCII white-space characters: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\\x20\\x09-\\x0D"
SPACE_RUN = f"[{SPACE}]+"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(text: Column) -> Column:
    """Whether ``text`` holds ASCII white space only; what follows the first other character is not read."""
    return F.ltrim(text, F.lit(" \t\n\v\f\r")) == ""


def pieces_of(text: Column, line: bool = False) -> Column:
    """Words in order, and empty strings.

    Text whose only white space is spaces and line feeds needs no regular expression to be split;
    a ``line`` has no line feeds.
    """
    plain = F.split(text if line else F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    other = reduce(or_, (F.contains(text, F.lit(c)) for c in "\t\v\f\r"))
    return F.when(other, F.split(text, SPACE_RUN)).otherwise(plain)


def words(text: Column, line: bool = False) -> Column:
    """Maximal runs of characters other than ASCII white space, in order; a ``line`` has no line feeds."""
    return F.array_remove(pieces_of(text, line), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are in the regex class body ``characters``."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))
