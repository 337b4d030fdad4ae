"""Spans as pairs of Columns, and per-document orders of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (e1 > s2)


def contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The first holds the second and is longer."""
    return (s1 <= s2) & (e1 >= e2) & ((e1 - s1) > (e2 - s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the intersection over that of the union; 0 for empty spans."""
    shared = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    union = (e1 - s1) + (e2 - s2) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def numbered(prefix: str, number: Column, width: int = 3) -> Column:
    """Ids such as ent_001."""
    text = number.cast("string")
    return F.concat(F.lit(f"{prefix}_"), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")))
