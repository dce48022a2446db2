"""Scalar string helpers, all built-in Column expressions (JVM side)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DELIMITER_PATTERN, QUALIFIER_PATTERN

_UPPER = string.ascii_uppercase
_LOWER = string.ascii_lowercase

# A string that a POSIX awk would read as the number zero (and so as "false"):
# optional blanks and sign, digits / point forms of zero, optional exponent.
AWK_ZERO_PATTERN = r"^[ \t\n]*[+-]?(0+\.?0*|\.0+)([eE][+-]?[0-9]+)?[ \t\n]*$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c) -> Column:
    """Lower-case A-Z only, leaving every other character alone (F1)."""
    return F.translate(col_(c), _UPPER, _LOWER)


def unicode_lower(c) -> Column:
    """Unicode lower-case (F2)."""
    return F.lower(col_(c))


def split_words(c) -> Column:
    """Split a caption on single spaces; empty pieces are kept."""
    return F.split(col_(c), " ", -1)


def split_delimiters(c) -> Column:
    """Split on '-' or '_'; empty pieces are kept."""
    return F.split(col_(c), DELIMITER_PATTERN, -1)


def has_qualifier(c) -> Column:
    """True when the label ends in a ``_(qualifier)`` group."""
    return col_(c).rlike(QUALIFIER_PATTERN)


def qualifier_nominal(c) -> Column:
    return F.regexp_extract(col_(c), QUALIFIER_PATTERN, 1)


def qualifier_value(c) -> Column:
    return F.regexp_extract(col_(c), QUALIFIER_PATTERN, 2)


def char_length(c) -> Column:
    """Length in characters (code points)."""
    return F.char_length(col_(c))


def awk_truthy(c) -> Column:
    """awk's truth test of a field: non-empty and not a zero-looking number."""
    c = col_(c)
    return (c != "") & ~c.rlike(AWK_ZERO_PATTERN)


def file_key(booru, fid) -> Column:
    """Caption key ``BOORU_FID`` (F8)."""
    return F.concat_ws("_", col_(booru), col_(fid).cast("string"))


def lenient_int(c) -> Column:
    """awk ``%d`` coercion: leading integer of the text, 0 when there is none."""
    lead = F.regexp_extract(col_(c), r"^\s*([+-]?[0-9]+)", 1)
    # Only digit text reaches the cast (an empty match would take its slow
    # failure path); out-of-range numbers still become NULL, then 0.
    return F.coalesce(F.when(lead != "", lead).try_cast("int"), F.lit(0))
