"""Texts shown to the user: rounded borders, intervals, rule sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDING = 1e6  # borders are shown with six decimal places, halves go up


def rounded(value: Column) -> Column:
    scaled = value * F.lit(ROUNDING) + F.lit(0.5)
    # beyond 2**53 a double has no fraction left to round, and infinities stay
    return F.when(F.abs(scaled) < F.lit(2.0**53), F.floor(scaled) / F.lit(ROUNDING)).otherwise(value)


def interval_label(start: Column, end: Column, start_inclusive: Column, end_inclusive: Column) -> Column:
    return F.concat(
        F.when(start_inclusive, F.lit("[")).otherwise(F.lit("(")),
        rounded(start).cast("string"),
        F.lit(","),
        rounded(end).cast("string"),
        F.when(end_inclusive, F.lit("]")).otherwise(F.lit(")")),
    )

