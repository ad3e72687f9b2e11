"""String helpers shared by the gates, chunking and safety functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(text: Column | str) -> Column:
    """Null, empty or whitespace-only (Unicode white space)."""
    t = col_(text)
    return t.isNull() | t.rlike(r"(?U)^\s*$")


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 code units: code points plus one per supplementary character."""
    t = col_(text)
    return F.length(t) + F.coalesce(F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]")), F.lit(0))


def literal_split_regex(separator: str) -> str:
    """A Java regex matching ``separator`` literally."""
    return re.escape(separator) if separator else r"(?!)"
