"""A column that is evaluated once per row, whatever reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a one-row generator.

    A filter on columns made from ``value`` would be pushed below a plain
    projection and evaluate it again for each mention; it stays above a
    generator.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))
