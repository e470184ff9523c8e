"""Column helpers on text: Unicode white space, literal counts, lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Ranges come first, since looking up a character's script takes many times as long; all three scripts begin at U+2E80 or later.
JA_RANGES = r"[\x{2E80}-\x{10FFFF}]&&[ぁ-ゖァ-ヺ一-鿕\p{IsHiragana}\p{IsKatakana}\p{IsHan}]"
JA = f"[{JA_RANGES}]"
#: Noncharacters that mark places within a text while it is taken apart; they cannot be in a valid document.
MARK, NAMED, CUT, GAP, DOLLAR = "﷐", "﷑", "﷒", "﷓", "﷔"
MARKS = MARK + NAMED + CUT + GAP + DOLLAR


def text(s: str) -> Column:
    return F.lit(s)


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, however often use looks at it."""
    return F.transform(F.array(x), use)[0]


def fenced(x: Column) -> Column:
    """x as a column that the optimizer neither copies into filters above nor computes again for each use.

    Filters on derived columns are pushed below their projection, and would take the whole derivation along, once for
    each mention. No expression that reads the partition's number can be moved, and every number is 0 or more.
    """
    return F.when(F.spark_partition_id() >= 0, x)


def trim(x: Column) -> Column:
    return F.btrim(x, text(SPACE))


def rtrim(x: Column) -> Column:
    return F.rtrim(x, text(SPACE))


def ltrim(x: Column) -> Column:
    return F.ltrim(x, text(SPACE))


def times(x: Column, literal: str) -> Column:
    """Occurrences of a literal, one behind the other."""
    gone = F.length(x) - F.length(F.replace(x, text(literal), text("")))
    return (gone if len(literal) == 1 else gone / len(literal)).cast("int")


def matches(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def first_match(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(x, pattern, group)


def holds(x: Column, *literals: str) -> Column:
    """Whether x has any of the literals; many times as fast as a pattern, which is then only tried where it can match."""
    return reduce(Column.__or__, (x.contains(s) for s in literals))


def ends(x: Column, *literals: str) -> Column:
    return reduce(Column.__or__, (x.endswith(s) for s in literals))


def swapped(x: Column, old: str, new: str) -> Column:
    """x with each character of old as the one of new at its place; for a few characters that most of a text has not. No new one may be among the old."""
    return reduce(lambda y, ab: F.replace(y, text(ab[0]), text(ab[1])), zip(old, new, strict=True), x)


def without(x: Column, chars: str) -> Column:
    return reduce(lambda y, a: F.replace(y, text(a), text("")), chars, x)


def lines_of(x: Column) -> Column:
    """Lines without their ends; a final line end begins no line, and an empty text has none."""
    cut = lambda t: F.split(F.regexp_replace(t, r"\n\z", ""), r"\r?\n", -1)
    plain = lambda t: bound(F.split(t, "\n", -1), lambda ls: F.when(t.endswith("\n"), F.slice(ls, F.lit(1), F.size(ls) - 1)).otherwise(ls))
    return bound(x, lambda t: F.when(t == "", F.array().cast("array<string>")).when(t.contains("\r"), cut(t)).otherwise(plain(t)))
