"""Load-ready rows for a consumer that polls with ``since``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.functions.dates import UNREADABLE, article_date, parse_since, zone_text
from gleanmill.functions.text import text_of, translated_flag
from gleanmill.operators.files import article_files, skipped_files, stored_paths
from gleanmill.session import STATE_STORE


def _nothing():
    return F.lit(None).cast("string")


def known_origins(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Rows of registered origins only; an unknown origin reads as empty."""
    return rows.join(origins.select("origin_id"), "origin_id", "left_semi")


def modified_since(rows: DataFrame, since: str | None, column: str = "modified_at", on: bool = True) -> DataFrame:
    """Inclusive bound; ``on=False`` returns everything but still checks the text."""
    bound = parse_since(since)
    return rows if bound is None or not on else rows.where(F.col(column) >= F.lit(bound))


def taken_once(polled: DataFrame, key: str, at: str = "modified_at", back: str = "1 day") -> DataFrame:
    """What a consumer keeps of polls whose inclusive bounds deliver rows again.

    A row is its key and its time, so a record modified anew is taken anew.  On a
    stream no poll reaches back further than ``back``: older rows count as late,
    and state holds what is younger.  Rows without a time are for table polls
    only.
    """
    if not polled.isStreaming:
        return polled.dropDuplicates([key, at])
    for name, value in STATE_STORE.items():
        polled.sparkSession.conf.set(name, value)
    return polled.withWatermark(at, back).dropDuplicatesWithinWatermark([key, at])


def export_archives(metas: DataFrame) -> DataFrame:
    """Stored archive metas (camelCase, as scanned) to load-ready rows."""
    return metas.select(
        F.col("origin_id").alias("originId"),
        "source",
        text_of("registerNo").alias("dedupKey"),
        F.coalesce("menuId", F.lit("PAPERS")).alias("menuId"),
        "title", "titleEn", "publisher", "publisherEn",
        F.nullif("publishYear", F.lit("")).alias("publishYear"),
        text_of("author").alias("author"),
        "authorEn", "category", "categoryEn", "subCategory", "subCategoryEn",
        _nothing().alias("viewLocation"),
        F.lit("X").alias("hasFile"),
        "summary", "summaryEn", "linkUrl",
        text_of("registerNo").alias("registerNo"),
        _nothing().alias("callNo"),
        _nothing().alias("filePath"),
        "remark", "isbn", "coverUrl",
        F.lit("Y").alias("useYn"),
        F.lit("admin").alias("rgtrId"),
        translated_flag("titleEn", "summaryEn").alias("trslYn"),
        zone_text("modified_at").alias("collectedAt"),
    )


def export_articles(metas: DataFrame) -> DataFrame:
    """Stored article metas to load-ready rows with their files."""
    parsed = article_date("writedate")
    return metas.select(
        F.col("origin_id").alias("originId"),
        "title",
        F.col("content").alias("contentText"),
        F.col("currentUrl").alias("linkUrl"),
        text_of("writer").alias("writer"),
        F.coalesce(parsed, F.lit(UNREADABLE)).alias("regDt"),
        parsed.isNotNull().alias("regDtParsed"),
        F.lit("ko").alias("langCode"),
        translated_flag("title_en", "content_text_en").alias("trslYn"),
        F.col("title_en").alias("titleEn"),
        F.col("content_text_en").alias("contentTextEn"),
        zone_text("modified_at").alias("collectedAt"),
        article_files(_with_name(F.col("img")), F.col("file")).alias("files"),
        skipped_files(F.col("img"), F.col("file")).alias("skippedFiles"),
    )


def _with_name(items):
    """Pictures carry no original name of their own."""
    return F.transform(
        items, lambda i: F.struct(_nothing().alias("originalName"), i["url"].alias("url"), i["s3Path"].alias("s3Path"))
    )


def file_listing(metas: DataFrame) -> DataFrame:
    """Metas with the stored paths of their pictures and files instead of the lists."""
    empty = F.array().cast("array<string>")
    return metas.withColumns({
        "images": F.coalesce(stored_paths(F.col("img")), empty),
        "files": F.coalesce(stored_paths(F.col("file")), empty),
    }).drop("img", "file")
