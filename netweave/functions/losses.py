"""Reconstruction losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smooth_l1(x: Column, y: Column) -> Column:
    """Quadratic below a distance of one, linear above."""
    distance = F.abs(x - y)
    return F.when(distance < 1, distance * distance / 2).otherwise(distance - 0.5)


def mean_smooth_l1(x: Column, y: Column) -> Column:
    """Mean element loss between two flat arrays of equal length."""
    losses = F.zip_with(x, y, smooth_l1)
    return F.aggregate(losses, F.lit(0.0), lambda total, loss: total + loss) / F.size(x)


def sequence_error(sequence: Column, reconstruction: Column) -> Column:
    """Mean element loss between two matrices given as arrays of rows."""
    rows = F.zip_with(
        sequence,
        reconstruction,
        lambda a, b: F.aggregate(F.zip_with(a, b, smooth_l1), F.lit(0.0), lambda t, v: t + v),
    )
    cells = F.aggregate(sequence, F.lit(0), lambda n, row: n + F.size(row))
    return F.aggregate(rows, F.lit(0.0), lambda t, v: t + v) / cells
