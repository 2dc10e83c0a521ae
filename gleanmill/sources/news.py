"""News: archived article XML and captured RSS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.functions.dates import rfc822_to_zone, send_datetime
from gleanmill.functions.text import (
    body_to_text,
    byline_extract,
    html_to_text,
    inline_images,
    is_blank,
    matched_keywords,
    trimmed,
)
from gleanmill.functions.urls import image_base, image_url_fix
from gleanmill.operators.dedupe import array_first_by, merge_images
from gleanmill.rules.vocabulary import KEYWORDS
from gleanmill.schemas import NEWS_XML, RSS_ITEM

FILE = "_metadata.file_path"


def _month_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"/(\d{6})/[^/]+\z", 1)


def scan_news_xml(spark: SparkSession, root: str, month: str | None = None, files: str = "*.[xX][mM][lL]") -> DataFrame:
    """Every article file of the YYYYMM folders, or of one month.

    The month is a path glob, so other folders are not listed.  ``seq`` is
    (month, file name), the order the archive was written in.  A file may hold
    several articles; what cannot be read becomes a row with its text in
    ``_corrupt_record``, the others of the file are read all the same.
    """
    path = FILE
    folder = month or "[0-9][0-9][0-9][0-9][0-9][0-9]"
    return (
        spark.read.format("xml")
        .option("rowTag", "YNewsML")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        # record by record: the other parser gives up a file at its first damaged article
        .option("useLegacyXMLParser", True)
        .option("pathGlobFilter", files)
        .schema(NEWS_XML)
        .load(f"{root}/{folder}/")
        .select(
            "*",
            F.struct(_month_folder(F.col(path)).alias("month"), F.regexp_extract(F.col(path), "[^/]+$", 0).alias("file")).alias("seq"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
        )
    )


def news_xml_errors(scanned: DataFrame) -> DataFrame:
    """Files that are no article: unreadable, without title, or without any id."""
    return scanned.where(_xml_problem().isNotNull()).select("seq", _xml_problem().alias("problem"))


def _xml_problem() -> Column:
    no_id = is_blank("Header.ContentID") & is_blank("Metadata.Href")
    return (
        F.when(F.col("_corrupt_record").isNotNull(), "unreadable")
        .when(is_blank("NewsContent.Title"), "no title")
        .when(no_id, "no id")
    )


def xml_images(attachments: Column) -> Column:
    """Picture urls of the attachments, one per picture."""
    pictures = F.filter(attachments, lambda a: F.startswith(F.coalesce(a["_mimetype"], F.lit("")), F.lit("image/")))
    urls = F.filter(F.transform(pictures, lambda a: image_url_fix(a["Href"])), lambda u: u != "")
    return F.coalesce(array_first_by(urls, image_base), F.array().cast("array<string>"))


def articles_from_xml(scanned: DataFrame, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """Article rows; an unreadable date takes the file's own time."""
    title, subtitle = trimmed("NewsContent.Title"), trimmed("NewsContent.SubTitle")
    base = scanned.where(_xml_problem().isNull()).select(
        trimmed("Header.ContentID").alias("guid"),
        title.alias("title"),
        trimmed("Metadata.Href").alias("link"),
        send_datetime("Header.SendDate", "Header.SendTime", "modified_at").alias("reg_dt"),
        trimmed("Metadata.Writer").alias("_writer"),
        body_to_text(trimmed("NewsContent.Body"), title, subtitle).alias("content"),
        xml_images(F.col("NewsContent.AppendData")).alias("img_urls"),
        subtitle.alias("_subtitle"),
        "seq",
    )
    text = F.concat_ws("\n", "title", "_subtitle", "content")
    return base.select(
        "guid", "title", "link", "reg_dt",
        F.when(F.col("_writer") == "", byline_extract("content")).otherwise(F.col("_writer")).alias("writer"),
        "content", "img_urls", matched_keywords(text, keywords).alias("matched_keywords"), "seq",
    )


def rss_reader(reader, path: str) -> DataFrame:
    """RSS items of captured feed files; ``reader`` is spark.read or spark.readStream."""
    return (
        reader.format("xml")
        .option("rowTag", "item")
        .option("useLegacyXMLParser", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(RSS_ITEM)
        .load(path)
        .select("*", F.col("_metadata.file_modification_time").alias("captured_at"), F.col("_metadata.file_name").alias("capture"))
    )


def articles_from_rss(items: DataFrame, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """Article rows of feed items; items without title or link are dropped."""
    html = F.coalesce("description", F.lit(""))
    base = items.where(~is_blank("title") & ~is_blank("link")).select(
        trimmed("guid._VALUE").alias("guid"),
        trimmed("title").alias("title"),
        trimmed("link").alias("link"),
        rfc822_to_zone("pubDate", "captured_at").alias("reg_dt"),
        html_to_text(html).alias("content"),
        merge_images(inline_images(html), trimmed("enclosure._url")).alias("img_urls"),
        "captured_at", "capture",
    )
    return base.select(
        "guid", "title", "link", "reg_dt", byline_extract("content").alias("writer"), "content", "img_urls",
        matched_keywords(F.concat_ws("\n", "title", "content"), keywords).alias("matched_keywords"),
        "captured_at", "capture",
    )
