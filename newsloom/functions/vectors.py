"""Distances between embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision; NULL where either vector is NULL."""
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap))
