"""Casts that give NULL on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(text: Column, kind: str = "int") -> Column:
    """``CAST(text AS INT)`` without ANSI: blanks trimmed, fraction cut, else NULL.

    The pattern decides first. ``try_cast`` alone raises and catches an error
    inside the JVM for every bad value, some hundred times the cost of a match.
    """
    digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)(\.[0-9]*)?\s*$", 1)
    return F.when(digits != "", digits).try_cast(kind)
