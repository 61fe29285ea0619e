"""Row predicates of the analysis questions and of search, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a school, a subject, a degree, and a score on the official scale.
JHU = r"(johns?\s+hopkins|\bjhu\b)"
COMPUTER_SCIENCE = r"(computer\s+science|\beecs\b)"
MASTERS = r"^\s*master"
PHD = r"^\s*ph\.?\s*d"
TARGET_SCHOOLS = (r"georgetown", r"massachusetts\s+institute\s+of\s+technology", r"stanford", r"(carnegie\s+mellon|\bcmu\b)")
MIT_ACRONYM = r"\bMIT\b"
NATIONALITIES = ("international", "american", "other")
GPA_RANGE = (0.0, 4.0)
SECTION_RANGE = (130.0, 170.0)
WRITING_RANGE = (0.0, 6.0)


def normalized(c: str | Column) -> Column:
    return F.lower(F.trim(c))


def equals(c: str | Column, value: str) -> Column:
    """Equal but for case and outer spaces; ``value`` is in lower case."""
    return normalized(c) == F.lit(value)


def one_of(c: str | Column, values: tuple[str, ...]) -> Column:
    return normalized(c).isin(*values)


def accepted(c: str = "status") -> Column:
    return F.trim(c).ilike("accept%")


def matches(c: str, pattern: str) -> Column:
    """A regular expression anywhere in the text, in any case."""
    return F.col(c).rlike("(?iU)" + pattern)


def at_target_school(c: str) -> Column:
    return reduce(or_, [matches(c, p) for p in TARGET_SCHOOLS], F.col(c).rlike("(?U)" + MIT_ACRONYM))


def valid_gpa(c: str = "gpa") -> Column:
    return (F.col(c) > GPA_RANGE[0]) & (F.col(c) <= GPA_RANGE[1])


def valid_section(c: str) -> Column:
    return F.col(c).between(*SECTION_RANGE)


def valid_writing(c: str = "gre_aw") -> Column:
    return F.col(c).between(*WRITING_RANGE)


def contains(c: str, value: str) -> Column:
    """A substring in any case; the value has no wildcards."""
    return F.lower(F.col(c)).contains(value.lower())
