"""Numeric helpers: rounding that matches numpy, safe percentages, min-max scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(c: Column, digits: int) -> Column:
    """numpy-style rounding: ``rint(x * 10^k) / 10^k`` (ties to even on the scaled value)."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def pct(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` in double; 0 when ``whole`` is 0 (the reference's monthly rule)."""
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))
