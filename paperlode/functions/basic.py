"""Small text building blocks with Unicode-aware white space."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlode import rules

MARK = "\u0001"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column) -> Column:
    """Trim every kind of white space on both ends."""
    return F.btrim(c, F.lit(rules.SPACE_CHARS))


def rstrip(c: Column, chars: str = rules.SPACE_CHARS) -> Column:
    return F.rtrim(c, F.lit(chars))


def squeeze(c: Column) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return strip(F.regexp_replace(c, rules.SPACE + "+", " "))


def not_blank(c: Column) -> Column:
    """True if the value holds anything but white space; null counts as blank."""
    return strip(F.coalesce(c, F.lit(""))) != ""


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, parts: list[str]) -> Column:
    return any_of([c.contains(p) for p in parts])


def ends_with_any(c: Column, endings: list[str]) -> Column:
    return any_of([c.endswith(e) for e in endings])


def keep_non_blank(parts: Column) -> Column:
    """Trimmed array elements that are not blank."""
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def count_of(text: Column, part: Column) -> Column:
    """Occurrences of a non-empty substring, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")
