"""Searches, pages and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(
    rows: DataFrame,
    field: str | None = None,
    keyword: str | None = None,
    created: str = "created_at",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Case-insensitive contains on a field; the date range only counts with both ends."""
    if field and keyword:
        rows = rows.where(F.contains(F.lower(F.coalesce(F.col(field).cast("string"), F.lit(""))), F.lit(keyword.lower())))
    if start and end:
        rows = rows.where(F.col(created).between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))
    return rows


def newest_page(rows: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """Page n of size m with the total of all rows beside each row."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("total", total)


def first_rows(rows: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows in order: new rows of a chunked run, previews, samples."""
    return rows.orderBy(*order).limit(n)
