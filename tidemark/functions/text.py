"""Column functions over titles, texts and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that a title key drops.
DROPPED = "[‘’‚‛'`´.]"


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(F.trim(text), "\n", 1))


def title_key(title: Column) -> Column:
    """Form in which titles that differ by case, marks or spaces alone are equal."""
    x = F.regexp_replace(F.replace(F.lower(title), F.lit("ß"), F.lit("ss")), DROPPED, "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def is_minor(old: Column, new: Column) -> Column:
    return title_key(old) == title_key(new)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
