"""Evaluate expensive expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of recomputing.

    The optimizer substitutes a plain computed column into every filter above it, so
    a JSON parse would run once per use. Generated columns are not substituted.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(values)))
