"""Folded form of ids, relations and labels as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(value: Column) -> Column:
    """Lower-case, then drop everything that is not a Unicode letter (L) or number (N); null stays null."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")


def not_blank(value: Column) -> Column:
    """True if the value is neither null nor made of white space only."""
    return F.coalesce(value.rlike(r"[^\s\p{Z}]"), F.lit(False))


def present_fold(value: Column) -> Column:
    """Folded form of a value that is not blank, else null."""
    return F.when(not_blank(value), fold(value))
